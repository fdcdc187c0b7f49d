"""BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be merged over:
whatever the merges do, there is a token boundary between the two. Such pairs cut
a text into short fragments whose encodings, concatenated, are the encoding of the
text. Fragments recur, so each is encoded once for a worker's cache.

The merges are not the only rule: the file's pre-tokenizer splits first, with a
pattern that looks ahead only in runs of white space and that starts a contraction
at an apostrophe. A cut is therefore used only where matching may start afresh
with the same result: not behind white space, not before an apostrophe, and not
within a character. Behind the strings of added tokens, which the library takes
out of a text first, the text begins anew as well. All that holds for files of that
one shape; with any other the library gets whole texts. A very long text is cut like any
other: its fragments are as short, and memory grows with its length only.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table, text_of
from lodestar.llm.tokenizers_io import BYTE_BPE, byte_alphabet, library, path_of, shape, vocabulary

#: Fragments that a worker's cache holds; it is emptied beyond. Bounds memory only.
CACHE_FRAGMENTS = 120_000
#: A longer fragment is encoded but not kept in the cache.
CACHED_BYTES = 64
#: Last bytes (in UTF-8) of the white space beyond ASCII: U+0085, U+00A0, U+1680,
#: U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000. Fixed values.
WIDE_SPACE_ENDS = (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)
#: Bytes that the pre-tokenizer's pattern takes for white space, or that may be one for it.
NARROW_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20)


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: may the text be cut between these two bytes?"""
    inside = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        codes = np.frombuffer(token, dtype=np.uint8)
        inside[codes[:-1], codes[1:]] = True
    cut = ~inside
    cut[list(NARROW_SPACES), :] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False  # within a character
    # A letter such as U+00E9 ends in a byte that ends a wide space too: the lead
    # byte, two or three before, would be needed to tell them apart, so no cut.
    cut[list(WIDE_SPACE_ENDS), :] = False
    return cut


class Codec:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        model, self.added = vocabulary(path)
        self.library = library(path)
        alphabet = byte_alphabet()
        self.bytes_of: dict[int, bytes] = {}
        for token, number in model.items():
            self.bytes_of[number] = bytes(alphabet[c] for c in token if c in alphabet)
        self.cut = cut_table(list(self.bytes_of.values())).ravel()
        self.numbers = dict(self.added)
        for content, number in self.added:
            self.bytes_of[number] = content.encode()
        longest = sorted(self.numbers, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        #: Only for a file of the known shape do fragments encode as they do within the text.
        self.cuts_hold = shape(path) == "byte"
        self.cache: dict[bytes, tuple[str, int, bytes]] = {}

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the fragments, the text's own end last."""
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint16)
        ends = np.flatnonzero(self.cut[(codes[:-1] << 8) | codes[1:]]) + 1
        return [*ends.tolist(), len(data)]

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text between added tokens, and the added tokens' ids."""
        if self.marks is None or not self.marks.search(text):
            return [(text, None)] if text else []
        # Leftmost first and of several the longest, as the library takes them.
        return [(piece, self.numbers[piece] if i % 2 else None) for i, piece in enumerate(self.marks.split(text)) if piece]

    def entry(self, fragment: bytes, ids: list[int]) -> tuple[str, int, bytes]:
        """A fragment's ids as text, their number, and the bytes that they decode to."""
        return ",".join(map(str, ids)), len(ids), b"".join([self.bytes_of[i] for i in ids])

    def learn(self, fragments: list[bytes]) -> dict[bytes, tuple[str, int, bytes]]:
        """Encode fragments with the library; keep short ones."""
        unknown = list(set(fragments))
        encoded = self.library.encode_batch_fast([f.decode() for f in unknown], add_special_tokens=False)
        found = {f: self.entry(f, e.ids) for f, e in zip(unknown, encoded, strict=True)}
        if len(self.cache) + len(found) > CACHE_FRAGMENTS:
            self.cache.clear()
        self.cache.update((f, x) for f, x in found.items() if len(f) <= CACHED_BYTES)
        return found

    def encoded(self, text: str) -> list[tuple[str, int, bytes]]:
        """The fragments of a text, each with its ids."""
        if not self.cuts_hold:
            ids = self.library.encode(text, add_special_tokens=False).ids
            return [(",".join(map(str, ids)), len(ids), self.library.decode(ids, skip_special_tokens=False).encode())] if ids else []
        result: list[tuple[str, int, bytes]] = []
        for part, known in self.parts(text):
            if known is not None:
                result.append(self.entry(part.encode(), [known]))
                continue
            data = part.encode()
            ends = self.cuts(data)
            fragments = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if data else []
            got = list(map(self.cache.get, fragments))
            if None in got:
                found = self.learn([f for f, x in zip(fragments, got, strict=True) if x is None])
                got = [x if x is not None else found[f] for f, x in zip(fragments, got, strict=True)]
            result += got
        return result

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return [int(i) for x in self.encoded(text) for i in x[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; malformed bytes become U+FFFD."""
        if not self.cuts_hold:
            return self.library.decode(ids, skip_special_tokens=False)
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def digests(docs: DataFrame, path: str = BYTE_BPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: tokens, digest of the ids, digest of the decoded text.

    A null text counts as empty (no tokens); a null id stays null; repeated rows
    give repeated results; columns beyond the two named are not read.
    """
    place = path_of(path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        own = codec(place)
        counts, ids, decoded = [], [], []
        for text in texts:
            found = own.encoded(text)
            counts.append(sum([x[1] for x in found]))
            ids.append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([x[2] for x in found]).decode("utf-8", "replace").encode()).hexdigest())
        return pd.DataFrame({"n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded})

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), digested(text_of(docs, text_column)).alias("found"))
    return rows.select("doc_id", "found.*")


def encode(docs: DataFrame, path: str = BYTE_BPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ids themselves: doc_id, token_ids array<int>, decoded string."""
    place = path_of(path)

    @F.pandas_udf("token_ids array<int>, decoded string")
    def coded(texts: pd.Series) -> pd.DataFrame:
        own = codec(place)
        ids = [own.encode(text) for text in texts]
        return pd.DataFrame({"token_ids": ids, "decoded": [own.decode(x) for x in ids]})

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), coded(text_of(docs, text_column)).alias("found"))
    return rows.select("doc_id", "found.*")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe_codec": op9_bpe_codec}
ORACLES: dict[str, str] = {}
