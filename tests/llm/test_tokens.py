"""Token operators against the library."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

from lodestar.llm import bpe_codec, token_counts, wavelet_shards
from lodestar.llm.tokenizers_io import BYTE_BPE, WORD_BPE, library, path_of, shape

ALPHABET = "ab c'stdre \t\n\r\x0b\x1c\x85\xa0　é…ñÉ中1290!?.<|'ßà́️😀‍İΣ"
PIECES = ["<|endoftext|>", " 've", "\n\n", "  ", "<|startoftext|>", "'LL"]


def texts(n: int, seed: int, longest: int) -> list[str]:
    chooser = random.Random(seed)
    return ["".join(chooser.choice(ALPHABET) if chooser.random() < 0.9 else chooser.choice(PIECES) for _ in range(chooser.randint(0, longest))) for _ in range(n)]


def test_codec_is_the_library():
    own, other = bpe_codec.codec(path_of(BYTE_BPE)), library(path_of(BYTE_BPE))
    for text in texts(1500, 1, 40):
        ids = other.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token():
    own = bpe_codec.codec(path_of(BYTE_BPE))
    for token in own.bytes_of.values():
        if token not in [c.encode() for c, _ in own.added]:
            assert own.cuts(token) == [len(token)]


def test_splices_are_the_library():
    tokenizer = library(path_of(BYTE_BPE))
    chooser = random.Random(3)
    for k, text in enumerate(texts(1500, 2, 150)):
        if k % 3 == 0:  # without white space only widening helps
            text = "".join(text.split())
        chunk = chooser.randint(6, 40)
        spliced = token_counts.Spliced(tokenizer, chunk, chooser.randint(1, chunk - 1))
        assert spliced.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_segments_are_the_library():
    tokenizer = library(path_of(BYTE_BPE))
    segments = token_counts.Segments(tokenizer)
    for text in texts(3000, 6, 60):
        assert segments.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
        plain = "".join(c for c in text if c.isascii() and c not in "\x1c")
        assert segments.count(plain) == len(tokenizer.encode(plain, add_special_tokens=False).ids), plain


def test_word_ids_are_the_library():
    tokenizer = library(path_of(WORD_BPE))
    encoder = wavelet_shards.WordEncoder(path_of(WORD_BPE))
    found = texts(1500, 4, 40)
    for text, ids in zip(found, encoder.encode(found), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 9, 5000, 300_000])
def test_wavelet_matrix(n):
    random_ = np.random.default_rng(n)
    ids = (random_.zipf(1.3, n) % 49_000).astype(np.uint16)
    matrix = wavelet_shards.WaveletMatrix(wavelet_shards.pack(ids, [5, None], [n, 0], 16))
    assert matrix.doc_ids == [5, None] and matrix.lengths.tolist() == [n, 0]
    assert (matrix.decode() == ids).all()
    for i in random_.integers(0, n, 5).tolist() if n else []:
        symbol = int(ids[i])
        places = np.flatnonzero(ids == symbol)
        assert matrix.access(i) == symbol
        assert matrix.count(symbol) == len(places)
        assert matrix.rank(symbol, i) == (places < i).sum()
        k = int((places < i).sum())
        assert matrix.select(symbol, k) == i
        assert (matrix.occurrences(symbol) == places).all()
    assert matrix.count(48_999) == (ids == 48_999).sum() and matrix.count(1 << 20) == 0
    with pytest.raises(IndexError):
        matrix.access(n)


def test_other_files_go_to_the_library(spark, messy, messy_rows, tmp_path):
    """A short cut holds for its own file only; with another the results are the library's, too."""
    found = [*texts(300, 5, 40), "Hello World, it is fine."]
    for path, other in ((path_of(BYTE_BPE), library(path_of(BYTE_BPE))), (path_of(WORD_BPE), library(path_of(WORD_BPE)))):
        encoder, own = wavelet_shards.WordEncoder(path), bpe_codec.Codec(path)
        for text, ids in zip(found, encoder.encode(found), strict=True):
            want = other.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, encoder.kind).tolist() == want and own.encode(text) == want
            assert own.decode(want) == other.decode(want, skip_special_tokens=False)
    tokenizer = library(path_of(WORD_BPE))
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.counts(messy, path=WORD_BPE).collect())
    assert got == sorted((str(r[0]), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in messy_rows)
    assert (shape(path_of(BYTE_BPE)), shape(path_of(WORD_BPE))) == ("byte", "word")
    changed = json.loads(open(path_of(BYTE_BPE), encoding="utf-8").read())
    changed["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(changed))
    assert shape(str(tmp_path / "other.json")) is None


def test_added_tokens_are_taken_leftmost_and_longest():
    own = bpe_codec.Codec(path_of(BYTE_BPE))
    own.numbers = {"<|a|>": 1, "<|a|>b": 2, "|>b": 3}
    own.marks = re.compile("(" + "|".join(map(re.escape, sorted(own.numbers, key=len, reverse=True))) + ")")
    assert own.parts("x<|a|>by|>b<|a|>") == [("x", None), ("<|a|>b", 2), ("y", None), ("|>b", 3), ("<|a|>", 1)]


@pytest.mark.parametrize("size", [3_000_000])
def test_texts_of_megabytes(spark, size):
    text = ("word éé 12 <|x|> it's\n" * (size // 20))[:size]
    tokenizer = library(path_of(BYTE_BPE))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.counts(docs).first()["n_tokens"] == len(ids)
    assert bpe_codec.digests(docs).first()["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_one_file_opens_alone(spark, messy, tmp_path):
    out = str(tmp_path / "shards")
    wavelet_shards.write_shards(messy, out, shard_tokens=2_000)
    rows = spark.read.parquet(f"{out}/shards").orderBy("part", "seq").collect()
    assert len(rows) > 1
    for row in rows:
        matrix = wavelet_shards.open_shard(row["file"])
        ids = matrix.decode()
        assert (matrix.n_docs, matrix.n) == (row["n_docs"], row["n_tokens"])
        assert matrix.access(len(ids) // 2) == ids[len(ids) // 2]
        assert (matrix.occurrences(2) == np.flatnonzero(ids == 2)).all() and matrix.count(2) == row["n_docs"]


def test_op9_and_op4_rows(messy, messy_rows, empty):
    tokenizer = library(path_of(BYTE_BPE))
    want9, want4 = [], []
    for row in messy_rows:
        text = row[1] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want9.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        want4.append((row[0], len(text.encode()), len(ids), len(ids) > 1024))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe_codec.digests(messy).collect()), key=key) == sorted(want9, key=key)
    assert sorted(map(tuple, token_counts.counts(messy).collect()), key=key) == sorted(want4, key=key)
    small = token_counts.counts(messy, chunk=512, overlap=32)
    assert sorted(map(tuple, small.collect()), key=key) == sorted(want4, key=key)
    assert bpe_codec.digests(empty).collect() == [] and token_counts.counts(empty).collect() == []
    assert bpe_codec.encode(empty).collect() == []


def test_op5_rows(spark, messy, messy_rows, empty, tmp_path):
    out = str(tmp_path / "shards")
    wavelet_shards.write_shards(messy, out, shard_tokens=500)
    rows = [tuple(r) for r in wavelet_shards.read_documents(spark, out).collect()]
    tokenizer = library(path_of(WORD_BPE))
    want = []
    for row in messy_rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((row[0], len(ids), zlib.crc32(ids.tobytes())))
    key = lambda r: tuple(map(str, r))
    assert sorted([(d, n, c) for d, _, n, c in rows], key=key) == sorted(want, key=key)
    rows.sort(key=lambda r: r[1])
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
    ids = [-1 if r[0] is None else r[0] for r in rows]
    assert ids == sorted(ids)
    wavelet_shards.write_shards(empty, out + "2")
    assert wavelet_shards.read_documents(spark, out + "2").collect() == []
