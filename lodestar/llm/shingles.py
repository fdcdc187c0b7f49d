"""Hashes of words and of word shingles, in numpy, for the Python operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
CACHE_WORDS = 150_000
_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Odd 64-bit constants of a multiply-and-shift mixer, and one for each word's place.
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (two rounds of shift and multiplication)."""
    x = (x ^ (x >> _SHIFT)) * _MIX_1
    x = (x ^ (x >> _SHIFT)) * _MIX_2
    return x ^ (x >> _SHIFT)


def words(text: str) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    # str.split() is three times as fast, but also splits at other white space.
    return text.split() if text.isascii() and not _ODD.search(text) else _WORD.findall(text)


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when it has grown large, which bounds memory."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_hashes(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash for each window of n words; all words as one if there are fewer; none of none."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    total = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        total += mixed(hashes[k : k + count] + np.uint64((k + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
    return mixed(total)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Hashes of a text's word shingles, in order, with repeats."""
    return shingle_hashes(word_hashes(words(text)), n)
