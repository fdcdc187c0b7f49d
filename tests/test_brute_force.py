"""Queries that SQL can't express, whole at sf0.01, against plain Python."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest

from lodestar import catalog
from lodestar.functions import bits
from lodestar.operators import chunking
from lodestar.plans.vectors import base, label_centres

FOLDER = "/root/testdata/sf0.01"


def rows_of(spark, name):
    return catalog.queries()[name](spark, FOLDER).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = base(spark, FOLDER).orderBy("id").collect()
    return np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows])


SENTENCE = re.compile(r"[.!?][\"')\]]*(?:\s+|\Z)|\n\s*\n")


def plain_sentences(text, size=512, overlap=64):
    """The rule, with the list of all ends looked through for each chunk."""
    if not text.strip():
        return []
    ends = [m.end() for m in SENTENCE.finditer(text)]
    ends = ends if ends and ends[-1] == len(text) else [*ends, len(text)]
    found, start = [], 0
    while start < len(text):
        limit = start + size
        stop = len(text)
        if limit < len(text):
            inside = [e for e in ends if start < e <= limit]
            blank = text.rfind(" ", start + 1, limit)
            stop = inside[-1] if inside else blank + 1 if blank > start else limit
        if text[start:stop].strip():
            found.append((start, text[start:stop].strip()))
        if stop >= len(text):
            break
        back = [e for e in ends if max(start + 1, stop - overlap) <= e < stop]
        start = back[0] if back else stop
    return found


def plain_tokens(text, size=128, overlap=16):
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    ends = [m.end() for m in SENTENCE.finditer(text)] + [len(text)]
    last = {i for i, (_, stop) in enumerate(words) if i + 1 == len(words) or any(stop <= e <= words[i + 1][0] for e in ends)}
    found, start = [], 0
    while start < len(words):
        inside = [i + 1 for i in sorted(last) if start <= i < start + size]
        stop = inside[-1] if inside else min(len(words), start + size)
        found.append((words[start][0], text[words[start][0] : words[stop - 1][1]]))
        if stop >= len(words):
            break
        start = max(start + 1, stop - overlap)
    return found


def test_chunks(spark, texts):
    for name, rule in (("sentence_chunks", plain_sentences), ("token_chunks", plain_tokens)):
        got = sorted((r["id"], r["chunk"], r["start"], r["digest"]) for r in rows_of(spark, name))
        want = sorted((i, k, start, hashlib.md5(piece.encode()).hexdigest()) for i, text in texts.items() for k, (start, piece) in enumerate(rule(text)))
        assert got == want, name


def test_counts_of_chunks(spark, texts):
    whole = {i: chunking.by_markdown(t) for i, t in texts.items()}
    children = Counter({i: sum(len(plain_sentences(piece)) for _, piece, _ in found) for i, found in whole.items()})
    got = {r["id"]: (r["children"], r["last_parent"]) for r in rows_of(spark, "parent_child_chunks")}
    assert got == {i: (n, len(whole[i]) - 1) for i, n in children.items() if n}
    assert {r["id"]: (r["chunks"], r["numbers"]) for r in rows_of(spark, "ingestion_pipeline")} == {i: (len(found), 16 * len(found)) for i, found in whole.items() if found}


def test_word_tokens(spark, texts):
    want = {}
    for i, text in texts.items():
        found = [m.span() for m in re.finditer(r"\w+(?:['’]\w+)*", text)]
        if found:
            want[i] = (len(found), sum(a for a, _ in found), max(b for _, b in found))
    assert {r["id"]: (r["n"], r["starts"], r["last"]) for r in rows_of(spark, "word_tokens")} == want


def test_information_of_groups(spark, vectors):
    ids, x = vectors
    got = {r["group_id"]: r["phi"] for r in rows_of(spark, "integrated_information")}
    for group in sorted(set(ids // 8)):
        own = x[ids // 8 == group]
        gram = own @ own.T + 1e-3 * np.eye(len(own))
        assert abs(got[group] - 0.5 * (np.log(np.diag(gram)).sum() - np.log(np.linalg.det(gram)))) < 2e-4


def test_filters_of_tags(spark):
    got = {r["id"]: r["bits"] for r in rows_of(spark, "bloom_tags")}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "source").collect():
        value = 0
        for tag in (r["lang"], r["source"]):
            value |= bits.tag_bits(tag) if tag is not None else 0
        assert got[r["doc_id"]] == value.bit_count()


def plain_bundle(text, n=3):
    """The majority of all grams' bits, one gram after the other."""
    grams = [text[i : i + n] for i in range(max(1, len(text) - n + 1))]
    total = sum((bits.gram_vector(g).astype(int) for g in grams), np.zeros(bits.DIMENSIONS, int)) * 2
    return np.where(total == len(grams), bits.gram_vector(grams[0]), total > len(grams))


def test_bundles_of_texts(spark, texts, monkeypatch):
    random = np.random.default_rng(2)
    odd = ["", "a", "ab", "abc", "abcd", "aaaa" * 99, "abab", "ab" * 500 + "c", "日本語😀😀 x", "".join(map(chr, random.integers(0x4E00, 0x9000, 3000)))]
    for text in odd:
        assert (bits.text_vector(text) == plain_bundle(text)).all()
        assert (bits.text_vector(text, 4) == plain_bundle(text, 4)).all()
    with monkeypatch.context() as patched:
        for size in (7, 64):
            patched.setattr(bits, "GRAMS", size)
            patched.setattr(bits, "SYMBOLS", 100)
            bits.symbols.cache_clear()
            assert all((bits.text_vector(text) == plain_bundle(text)).all() for text in odd[:-1] + odd[::-1])
    bits.symbols.cache_clear()
    plain = [plain_bundle(texts[i].lower()) for i in range(20)]
    got = {r["id"]: r["next_similarity"] for r in rows_of(spark, "hdc_similarity")}
    assert sorted(got) == sorted(texts)[:-1]
    assert all(abs(got[i] - (plain[i] == plain[i + 1]).mean()) < 6e-5 for i in range(19))


def test_bundles_cost_little(texts):
    """A text takes a few milliseconds, not a pass over all dimensions for each of its grams."""
    some = [t.lower() for i, t in sorted(texts.items())[:100]]
    bits.text_vector("".join(some))
    began = time.thread_time()
    for text in some:
        bits.text_vector(text)
    assert time.thread_time() - began < 1.0


def test_products_and_cells(spark, vectors):
    """Every code and cell is the nearest one of its centres."""
    from lodestar.operators import vector_search as s

    ids, x = vectors
    quantizer = s.ProductQuantizer.trained(base(spark, FOLDER), 8, 32)
    codes = {r["id"]: r["codes"] for r in rows_of(spark, "pq_encode")}
    for i, row in zip(ids.tolist(), x, strict=True):
        for part, centres, code in zip(np.array_split(row, 8), quantizer.centres, codes[i], strict=True):
            d = ((centres - part) ** 2).sum(axis=1)
            assert d[code] <= d.min() + 1e-9
    assert sum(r["n"] for r in rows_of(spark, "k_means_cells")) == len(ids)
    assert len(label_centres(spark, FOLDER)) == 10


def test_rotated_codes_keep_lengths(spark, vectors):
    """Coarser codes lose more; with eight bits the squared length of a unit vector is near one."""
    for kind in ("turbo", "svasq"):
        error = [np.mean([abs(r["length"] - 1) for r in rows_of(spark, f"{kind}_quantize_{b}")]) for b in (8, 4, 2)]
        assert error[0] < 0.05 and error[0] < error[1] < error[2]


def test_principal_projection(spark, vectors):
    ids, x = vectors
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = {r["id"]: r["projected"] for r in rows_of(spark, "principal_projection")}
    want = np.abs(x @ axes[:3].T)
    assert all(np.allclose(got[i], want[k], atol=2e-4) for k, i in enumerate(ids.tolist()))
