"""Texts of some megabytes go through every operator whole."""

from __future__ import annotations

import pytest

from lodestar.llm import dart_dedup, factorization_toxicity, fourier_quality, mixing, multiset_hash, page_text, quality_rules, wavelet_shards
from lodestar.llm.tokenizers_io import WORD_BPE, library, path_of
from tests.llm.conftest import SCHEMA, make_words

N = 260_000  # words


@pytest.fixture(scope="module")
def big():
    found = make_words(42, N)
    return "\n".join(" ".join(found[i : i + 14]) for i in range(0, N, 14))


@pytest.fixture(scope="module")
def docs(spark, big):
    assert len(big) > 1_500_000
    near = big.replace("\n", "\nanders ", 40)
    rows = [(1, big, "en", "a", None, None, None, None), (2, near, "en", "a", None, None, None, None), (3, "one line of a few words that is short", "en", "b", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rules_and_mix(docs, big):
    counts = {r["doc_id"]: r["rules"] for r in quality_rules.with_rules(docs).collect()}
    assert counts[1]["n_words"] == N and counts[2]["n_words"] == N + 40 and counts[1]["word_chars"] == len(big) - big.count(" ") - big.count("\n")
    assert {r["doc_id"]: r["mix"]["size"] for r in mixing.with_copies(docs).collect()} == {1: N, 2: N + 40, 3: 9}


def test_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (factorization_toxicity.toxicity(docs, labels).collect(), fourier_quality.quality(docs, labels).collect()):
        assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)


def test_near_copies(docs):
    assert {r["doc_id"]: r["class_id"] for r in dart_dedup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_fingerprints(docs, big):
    rows = {r["doc_id"]: r for r in multiset_hash.fingerprints(docs).collect()}
    assert rows[1]["n_chars"] == len(big) and rows[1]["near_next"] > 0.9


def test_shards(spark, docs, big, tmp_path):
    out = str(tmp_path / "shards")
    wavelet_shards.write_shards(docs, out, shard_tokens=100_000)
    rows = {r["doc_id"]: r["n_tokens"] for r in wavelet_shards.read_documents(spark, out).collect()}
    assert rows[1] == len(library(path_of(WORD_BPE)).encode(big, add_special_tokens=False).ids) + 1


def test_pages(spark, big):
    html = "<body><article><h1>T</h1>" + "".join(f"<p>{line}</p>" for line in big.split("\n")) + "</article></body>"
    table = spark.createDataFrame([(1, "http://x.example/1", html)], "page_id long, url string, html string")
    assert page_text.with_text(table).first()["text"] == "T\n" + big
