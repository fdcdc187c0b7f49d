"""DartMinHash, components, near-duplicates."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from lodestar.llm import common, dart_dedup
from lodestar.llm.components import components
from lodestar.llm.shingles import shingles, words


def brute(rows, threshold=0.8, weights="count"):
    """Classes by all pairs, on texts."""
    texts = sorted({r[1] or "" for r in rows})
    sets = {t: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for t in texts}
    if weights == "one":
        sets = {t: Counter(set(s)) for t, s in sets.items()}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= (threshold - 1e-9) * (sets[a] | sets[b]).total():
                parent[root(a)] = root(b)
    by_id = {}
    for r in rows:  # texts of one id share a class
        if r[0] is not None and r[0] in by_id:
            parent[root(r[1] or "")] = root(by_id[r[0]])
        elif r[0] is not None:
            by_id[r[0]] = r[1] or ""
    ids, sizes = {}, {}
    for r in rows:
        k = root(r[1] or "")
        sizes[k] = sizes.get(k, 0) + 1
        if r[0] is not None:
            ids[k] = min(ids.get(k, r[0]), r[0])
    return sorted(((r[0], ids.get(root(r[1] or "")), sizes[root(r[1] or "")]) for r in rows), key=str)


def found(docs, weights="count"):
    return sorted((tuple(r) for r in dart_dedup.classes(docs, weights=weights).select("doc_id", "class_id", "class_size").collect()), key=str)


def test_signatures_estimate_weighted_similarity():
    random_ = np.random.default_rng(5)
    elements = random_.integers(0, 1 << 62, 120, dtype=np.uint64)
    a, b = random_.random(120) * 4, random_.random(120) * 4
    same = [np.mean(dart_dedup.signature(elements + np.uint64(i), a) == dart_dedup.signature(elements + np.uint64(i), b)) for i in range(12)]
    assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signature_of_few_and_of_none():
    one = dart_dedup.signature(np.array([7], dtype=np.uint64))
    assert not (one == dart_dedup._EMPTY).any()
    assert (one == dart_dedup.signature(np.array([7], dtype=np.uint64))).all()
    assert (dart_dedup.signature(np.zeros(0, dtype=np.uint64)) == dart_dedup._EMPTY).all()


def test_shingles_are_five_words():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles("")) == 0
    assert shingles("a b c d e")[0] == shingles("x a  b\nc d e")[1]


def test_classes_of_messy_rows(messy, messy_rows, empty):
    assert found(messy) == brute(messy_rows)
    assert found(messy, "one") == brute(messy_rows, weights="one")
    assert found(empty) == []


def test_chains_and_dense_groups(spark):
    """A group whose members are near to some others only, and one of equal similarity."""
    chooser = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):  # a chain: each text shifts the one before by a few words
        rows.append((i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 60))))
    for i in range(60):  # independent edits of a text that isn't there itself
        own = list(base)
        for k in chooser.sample(range(80), 2):
            own[k] = f"e{i}_{k}"
        rows.append((100 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_one_of_each(messy, messy_rows):
    kept = dart_dedup.one_of_each(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    classes = brute(messy_rows)
    assert len(rows) == len({c for _, c, _ in classes if c is not None}) + 1  # and the class without an id
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {c for _, c, _ in classes if c is not None}


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    more = components(spark.createDataFrame([(0, 100)], "a long, b long"), spark.createDataFrame(rows))
    assert {r["label"] for r in more.collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_blocks_and_pairs_agree(spark, monkeypatch):
    """Many texts just below the threshold of a group, some above: every path is exact."""
    chooser = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in chooser.sample(range(60), chooser.choice([1, 2, 3])):
            own[k] = f"e{i}_{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for pairs, size in ((64, 1 << 20), (0, 4000), (1 << 30, 1 << 20)):
        monkeypatch.setattr(dart_dedup, "PAIRS", pairs)
        monkeypatch.setattr(dart_dedup, "BLOCK_BYTES", size)
        monkeypatch.setattr(dart_dedup, "PROBE_BYTES", size)
        assert found(docs) == want


def test_multisets(spark):
    """With counts as weights the repeats matter."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, f"{text} {text}"), (3, f"{text} {text} {text} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["class_id"] for r in dart_dedup.classes(docs, weights="one").collect()}
    count = {r["doc_id"]: r["class_id"] for r in dart_dedup.classes(docs).collect()}
    assert one == {1: 1, 2: 1, 3: 1} and count == {1: 1, 2: 2, 3: 3}


def test_hot_keys_meet_by_broadcast(spark, messy, messy_rows, monkeypatch):
    """Beyond the broadcast bound hot buckets, texts and classes go another way, with the same result."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert found(messy) == brute(messy_rows)


def test_met(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(200)] + [(None, 1)], "k long, v long")
    keys = rows.where("k IS NOT NULL").groupBy("k").count().selectExpr("k", "k * 10 AS x", "count AS n")
    want = sorted((k, v, k * 10) for k, v in ((r["k"], r["v"]) for r in rows.collect()) if k is not None)
    for bound in (1 << 20, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        assert sorted(map(tuple, common.met(rows, keys, ["k"], 8).collect())) == want


def test_by_host(spark, monkeypatch):
    rows = spark.createDataFrame([(f"h{i % 3 if i % 2 else 0}", i, {"a": i}) for i in range(300)], "h string, v long, m map<string,long>")
    sites = spark.createDataFrame([("h0", [1]), ("h2", [2])], "h string, x array<int>")
    hosts = rows.groupBy("h").count().withColumnRenamed("count", "n")
    want = sorted((h, v, {"h0": [1], "h2": [2]}.get(h)) for h, v in ((r["h"], r["v"]) for r in rows.collect()))
    for n_bytes in (1, 1 << 40):
        for each in (10, 1000):
            monkeypatch.setattr(common, "HOST_ROWS", each)
            out = common.by_host(rows, sites, hosts, "h", n_bytes)
            assert out.columns == ["h", "v", "m", "x"]
            assert sorted((r["h"], r["v"], r["x"]) for r in out.collect()) == want
