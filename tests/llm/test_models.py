"""Classifiers and fingerprints."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import factorization_toxicity as fm
from lodestar.llm import fourier_quality as fq
from lodestar.llm import multiset_hash as mh
from tests.llm.conftest import make_text, make_words


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def labelled(spark, n=600):
    chooser = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 3 != 0
        found = make_words(i, chooser.randint(20, 90))
        if toxic:
            found.insert(chooser.randrange(len(found)), chooser.choice(["grobian", "tropfkopf"]))
        text = " ".join(found)
        if not good:
            text = " ".join(w.upper() + "###" for w in found)
        docs.append((i, text))
        if i % 7:
            labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r for r in labels.collect() if r["quality"] is not None}
    for rows, column, n, held in ((fm.toxicity(docs, labels).collect(), "toxic", 5, 0), (fq.quality(docs, labels).collect(), "quality", 4, 2)):
        assert len(rows) == 600
        assert all(r["held_out"] == (fold(r["doc_id"], n) == held) for r in rows)
        own = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
        assert np.mean([r["predicted"] == truth[r["doc_id"]][column] for r in own]) > 0.95
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_interaction_is_learnt():
    """Neither term alone means anything, both together do."""
    chooser = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = chooser.random(2) < 0.5
        rows.append(fm.terms(" ".join(["plain", *(["insultus"] if a else []), *(["gruppen"] if b else [])])))
        labels.append(float(a and b))
    machine = fm.fit(rows, np.array(labels), rate=0.2)
    scores = {t: machine.score(fm.terms("plain " + t)) for t in ("insultus", "gruppen", "insultus gruppen", "")}
    assert scores["insultus gruppen"] > 0.8 and max(scores["insultus"], scores["gruppen"], scores[""]) < 0.3


def test_neutral_partner_is_kept():
    """A partner that is as frequent with as without the label matters with an insult."""
    chooser = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(4000):
        partner = chooser.random() < 0.5
        insult = ["", "", "", "insultus", "tropfkopf"][i % 5]
        labels.append(float((insult == "insultus" and partner) or (insult == "tropfkopf" and not partner)))
        rows.append(fm.terms(" ".join(["plain", insult, "gruppen" if partner else "", f"w{chooser.integers(200)}"])))
    kept = fm.informative(rows, np.array(labels))
    assert np.isin(fm.terms("gruppen"), kept).any()
    machine = fm.fit(rows, np.array(labels), rate=0.2)
    scores = {t: machine.score(fm.terms("plain " + t)) for t in ("insultus gruppen", "insultus", "tropfkopf gruppen", "tropfkopf", "gruppen")}
    assert min(scores["insultus gruppen"], scores["tropfkopf"]) > 0.7 > 0.3 > max(scores["insultus"], scores["tropfkopf gruppen"], scores["gruppen"])


def test_bytes_of_terms_are_bounded(spark, monkeypatch):
    docs, labels = labelled(spark, 400)
    sent = []
    fitted = fm.fit
    monkeypatch.setattr(fm, "fit", lambda rows, y: (sent.append(sum(24 + r.nbytes for r in rows)), fitted(rows, y))[1])
    for bound in (1 << 30, 40_000):
        monkeypatch.setattr(fm, "TRAIN_BYTES", bound)
        assert fm.train(docs, labels) is not None
    assert sent[0] > 60_000 and sent[1] < 55_000


def test_messy_rows_and_no_labels(spark, messy, messy_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)], none.schema)
    for labels in (none, some):
        for found in (fm.toxicity(messy, labels), fq.quality(messy, labels)):
            rows = found.collect()
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in messy_rows)
            assert all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in rows)
        assert fm.toxicity(empty, labels).collect() == [] and fq.quality(empty, labels).collect() == []
        assert fq.filtered(messy, labels).columns == messy.columns
    assert fq.filtered(messy, none).count() == messy.count()


def test_isotonic():
    x, y = fq.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert np.allclose(x, [0.1, 0.25, 0.45]) and np.allclose(y, [0.0, 0.5, 1.0])


def test_fourier_features_approximate_the_kernel():
    model = fq.unfitted(np.zeros(fq.N_STATISTICS), np.ones(fq.N_STATISTICS), features=20_000)
    a, b = np.random.default_rng(1).normal(0, 1, (2, fq.N_STATISTICS))
    waves = model.features(np.stack([a, b]))[:, :-1]
    assert abs(waves[0] @ waves[1] - np.exp(-((a - b) ** 2).sum() / (2 * fq.N_STATISTICS))) < 0.03


def test_fingerprint_is_a_multiset_hash():
    parts = ["alpha beta gamma delta epsilon zeta", "one two", "alpha beta gamma delta epsilon zeta", "x y z u v w s t"]
    mark = mh.fingerprint("\n".join(parts))
    assert (mark == mh.fingerprint("\n\n".join(parts[::-1]))).all()
    assert (mark != mh.fingerprint("\n".join(parts[1:]))).any()
    assert (mh.insert(mh.fingerprint("\n".join(parts[1:])), parts[0]) == mark).all()
    assert (mh.delete(mark, parts[1]) == mh.fingerprint("\n".join([parts[0], *parts[2:]]))).all()
    assert (mh.of_text(mh.to_text(mark)) == mark).all()
    assert mh.likeness(mark, mark) == 1.0 and mh.likeness(mh.fingerprint(""), mh.fingerprint("")) == 1.0
    near = mh.likeness(mh.fingerprint(make_text(1)), mh.fingerprint(make_text(1) + "\n" + make_text(2, 12)))
    assert near > 0.7 > mh.likeness(mh.fingerprint(make_text(1)), mh.fingerprint(make_text(2)))


def plain_fingerprint(text):
    """Exact lanes as Python integers and the sketch as a dictionary, paragraph by paragraph."""
    import xxhash

    big = (1 << 64) - 1

    def mix(x):
        for constant in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * constant & big
        return x ^ (x >> 33)

    exact, sketch = [0] * 8, [0] * 160
    for line in text.split("\n"):
        found = [w for w in re.split("[ \t\x0b\x0c\r]+", line) if w]
        if not found:
            continue
        digest = hashlib.blake2b(" ".join(found).encode(), digest_size=64).digest()
        for i in range(8):
            exact[i] = (exact[i] + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) & big
        n = min(5, len(found))
        for at in range(len(found) - n + 1):
            total = n
            for k in range(n):
                total += mix((xxhash.xxh64_intdigest(found[at + k]) + (k + 1) * 0x9E3779B97F4A7C15) & big)
            gram = mix(total & big)
            sketch[(gram >> 32) % 160] += -1 if gram & 1 else 1
    return exact, sketch


def plain_likeness(a, b):
    if a == b:
        return 1.0
    length = sum(x * x for x in a[1] + b[1])
    return min(1.0, max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a[1], b[1], strict=True)) / length)) if length else 0.0


def test_fingerprints_against_plain_python(spark):
    texts = [make_text(i, 30 + 17 * i) for i in range(12)] + [make_text(3, 81) + "\nx", "", "one", " \n", "same line again\n" * 700, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in mh.fingerprints(docs).collect()}
    whole = [t or "" for t in texts]
    for i, text in enumerate(whole):
        after, half = whole[(i + 1) % len(whole)], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mark, edited_mark = plain_fingerprint(text), plain_fingerprint(edited)
        assert rows[i]["fingerprint"] == "".join(x.to_bytes(8, "little").hex() for x in mark[0]) + "".join((x % (1 << 32)).to_bytes(4, "little").hex() for x in mark[1])
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(rows[i]["near_edited"] - plain_likeness(mark, edited_mark)) < 1e-12
        assert abs(rows[i]["near_next"] - plain_likeness(mark, plain_fingerprint(after))) < 1e-12


def test_fingerprints_do_not_wrap():
    none, many = mh.fingerprint(""), mh.fingerprint("a b\n" * 65_536)
    assert (none != many).any() and mh.likeness(none, many) == 0.0
    whole, half = mh.fingerprint("a b c d e\n" * 40_000), mh.fingerprint("a b c d e\n" * 20_000)
    assert abs(mh.likeness(whole, half) - 0.8) < 1e-9


def test_score_is_the_sum_over_pairs():
    random_ = np.random.default_rng(2)
    places = np.unique(random_.integers(0, fm.PLACES, 40)).astype(np.int32)
    machine = fm.Machine(places, random_.normal(0, 1, len(places)), random_.normal(0, 0.5, (len(places), 5)), 0.3)
    for k in (0, 1, 2, 15):
        known = np.sort(random_.choice(len(places), k, replace=False))
        value = 0.3 + sum(machine.weights[i] for i in known) + sum(float(machine.factors[i] @ machine.factors[j]) for i in known for j in known if i < j)
        terms = np.unique(np.concatenate([places[known], random_.integers(0, fm.PLACES, 9).astype(np.int32)]))
        assert abs(machine.score(terms) - 1 / (1 + np.exp(-value))) < 1e-12


def test_gradient_is_that_of_the_loss():
    """The fit's gradient against differences of the loss summed over explicit pairs."""
    random_ = np.random.default_rng(4)
    rows = [np.unique(random_.integers(0, 6, random_.integers(1, 5))) for _ in range(9)]
    labels = (random_.random(9) < 0.5).astype(float)
    w, v = random_.normal(0, 1, 6), random_.normal(0, 1, (6, 3))

    def loss(w, v):
        total = 0.0
        for row, y in zip(rows, labels, strict=True):
            value = sum(w[i] for i in row) + sum(float(v[i] @ v[j]) for i in row for j in row if i < j)
            total += np.log1p(np.exp(value)) - y * value
        return total / len(rows)

    gw, gv = fm.gradient(rows, labels, w, v)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-6
        assert abs(gw[i] - (loss(w + step, v) - loss(w - step, v)) / 2e-6) < 1e-6
        for j in range(3):
            more = np.zeros((6, 3))
            more[i, j] = 1e-6
            assert abs(gv[i, j] - (loss(w, v + more) - loss(w, v - more)) / 2e-6) < 1e-6


def test_summed_normal_equations_are_the_ridge_solution(spark):
    docs, labels = labelled(spark, 400)
    model = fq.train(docs.repartition(5), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None and fold(r["doc_id"], 4) != 2]
    x = np.stack([fq.statistics(texts[i]) for i, _ in own])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-6, x.std(axis=0), model.scale))
    chosen = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(fq.CALIBRATION)) != 0).collect()}
    keep = [k for k, (i, _) in enumerate(own) if i in chosen]
    z, y = model.features(x[keep]), np.array([float(own[k][1] == 1) for k in keep])
    direct = np.linalg.solve(z.T @ z + fq.RIDGE * max(1.0, len(own) / 1000) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.weights, z @ direct, atol=1e-6)


def test_isotonic_against_brute_force():
    """The least squares rising fit, by the max-min formula of block means."""
    random_ = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        scores, labels = np.sort(random_.random(n)), (random_.random(n) < 0.5).astype(float)
        fit = [max(min(labels[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        x, y = fq.isotonic(scores, labels)
        assert (np.diff(y) > 0).all()
        at = [int(np.argmin([abs(v - f) for v in y])) for f in fit]
        assert np.allclose([y[k] for k in at], fit)
        assert np.allclose([np.mean(scores[np.array(at) == k]) for k in range(len(y))], x)


def test_two_labels_for_one_id(spark):
    docs, labels = labelled(spark, 200)
    more = labels.unionByName(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 1, 0)], labels.schema))
    for rows in (fm.toxicity(docs, more).collect(), fq.quality(docs, more).collect()):
        assert len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows)


def test_fingerprints_of_messy_rows(spark, messy, messy_rows, empty):
    import xxhash  # noqa: F401

    order = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for rows_each in (7, 512):
        rows = mh.fingerprints(messy, rows_each).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in messy_rows)
        got = {(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_sha256"]) for r in rows}
        texts = [r[1] or "" for r in order]
        for i, row in enumerate(order):
            after = texts[(i + 1) % len(order)]
            if sum(r[0] == row[0] for r in order) > 1 or order[(i + 1) % len(order)][0] in (None, 7):
                continue  # the order of equal ids is by a hash of the text
            text, half = texts[i], len(texts[i]) // 2
            edited = text[: len(text) - half] + after[:half]
            assert (row[0], len(text), mh.to_text(mh.fingerprint(text)), hashlib.sha256(edited.encode()).hexdigest()) in got
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert mh.fingerprints(empty).collect() == []
    alone = mh.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [r["edited_sha256"] for r in alone] == [hashlib.sha256(b"abab").hexdigest()]


def test_hot_ids_are_cut_by_the_text(spark):
    """Null ids and one id of many rows go to several ranges; every row has its successor."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, make_text(i, 10)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {r["range"]: r["count"] for r in mh.placed(docs, 8).where("NOT tail").groupBy("range").count().collect()}
    assert len(sizes) > 20 and max(sizes.values()) <= 40
    found = mh.fingerprints(docs, 8).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert sorted(r["fingerprint"] for r in found) == sorted(mh.to_text(mh.fingerprint(t)) for _, t in rows)
    whole = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]) for r in mh.fingerprints(docs, 1000).collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]) for r in found) == whole
