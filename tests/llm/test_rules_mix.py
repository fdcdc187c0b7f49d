"""Quality rules and mixing against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestar.llm import common, mixing, quality_rules
from tests.llm.conftest import SCHEMA, make_text, make_words

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    found = WORD.findall(text)
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(messy, messy_rows, empty):
    rows = quality_rules.with_rules(messy).select("doc_id", "kept", "rules.*").toDF("doc_id", "own_kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed", "base_failed", "verdict").collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows), key=str)
    want = []
    for r in messy_rows:
        n, chars, symbols, dup, rep = base(r[1] or "")
        want.append((r[0], n, chars, symbols, dup, rep, n < 10 or 100 * rep > 20 * n))
    assert got == sorted(want, key=str)
    assert quality_rules.with_rules(empty).collect() == []


def test_repeats_overlap(spark):
    texts = ["a b c d e a b c d e", "x x x x x x x", "a b c d e f a b c d e f g", "1 2 3 4 5 6 7 8 9 1 2 3 4 5", " ".join(f"w{i % 37}" for i in range(500)), "a\na\nb\n \n\na"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r["rules"] for r in quality_rules.with_rules(docs).collect()}
    for i, t in enumerate(texts):
        assert (rows[i]["n_dup_lines"], rows[i]["n_repeat_words"]) == base(t)[3:], t


def normal_lines(text):
    return [x for line in text.split("\n") if (x := " ".join(w for w in re.split("[\x20\t\x0b\x0c\r]+", line.lower()) if w))]


def brute_lines(rows):
    """(doc_id, kept) by the method, step by step in Python; edited copies by their keys."""
    texts = defaultdict(dict)  # host -> digest -> distinct normalised lines
    n_docs = defaultdict(set)
    for r in rows:
        t = int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16)
        n_docs[r[3]].add(t)
        texts[r[3]][t] = list(dict.fromkeys(normal_lines(r[1] or "")))
    gone = {}
    for host, own in texts.items():
        limit = max(10.0, len(n_docs[host]) * 0.01)
        count = Counter(x for lines in own.values() for x in lines)
        reached = {x for x, n in count.items() if n >= limit}
        first, keys = {}, {}
        for t, lines in own.items():
            common = sum(len(x.split(" ")) for x in lines if x in reached)
            rest = " ".join(x for x in lines if x not in reached).split()
            if not common or not rest or 100 * common < 5 * sum(len(x.split(" ")) for x in lines):
                continue
            grams = [int(hashlib.md5(" ".join(rest[i : i + 3]).encode()).hexdigest()[:15], 16) for i in range(max(1, len(rest) - 2))]
            keys[t] = [(k, min(g ^ m for g in grams)) for k, m in enumerate(quality_rules.MASKS)]
            for key in keys[t]:
                first[key] = min(first.get(key, t), t)
        copies = {t for t, own_keys in keys.items() if sum(first[k] < t for k in own_keys) >= 2}
        count = Counter(x for t, lines in own.items() if t not in copies for x in lines)
        gone[host] = {x for x in reached if count[x] >= limit}
    found = []
    for r in rows:
        n, _, _, _, repeats = base(r[1] or "")
        removed = sum(len(x.split(" ")) for x in normal_lines(r[1] or "") if x in gone[r[3]])
        found.append((r[0], removed, not (n < 10 or 100 * repeats > 20 * n) and not 100 * (n - removed) < 20 * n))
    return sorted(found, key=str)


def judged(docs):
    rows = quality_rules.with_rules(docs).select("doc_id", F.col("rules.removed_words").alias("removed"), F.col("rules.kept").alias("verdict"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def random_line(chooser, n=12):
    return " ".join("".join(chooser.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def edited(chooser, text, n):
    """The text with n words replaced, wherever they are."""
    lines = [line.split(" ") for line in text.split("\n")]
    for _ in range(n):
        line = chooser.choice(lines)
        line[chooser.randrange(len(line))] = random_line(chooser, 1)
    return "\n".join(" ".join(line) for line in lines)


def test_blocks_of_shared_lines(spark):
    """Blocks of 2 to 50 lines in 3 % and 10 % of a host: each of their lines is counted right."""
    chooser = random.Random(8)
    rows, share = [], {}
    for k, (n_lines, n_docs) in enumerate([(2, 60), (10, 60), (30, 60), (50, 60), (2, 200), (10, 200), (30, 200), (50, 200)]):
        host, block = f"h{k}", [random_line(chooser) for _ in range(n_lines)]
        for i in range(2_000):
            own = [random_line(chooser) for _ in range(1 if i < n_docs else 3)]
            rows.append((10_000 * k + i, "\n".join([*block, *own] if i < n_docs else own), None, host, None, None, None, None))
            share[10_000 * k + i] = (12 * n_lines, 1 / (n_lines + 1) >= 0.2) if i < n_docs else (0, True)
        rows += [(10_000 * k + 5_000 + i, rows[-1][1], None, host, None, None, None, None) for i in range(100)]  # exact copies stay
        share |= {10_000 * k + 5_000 + i: (0, True) for i in range(100)}
    docs = spark.createDataFrame(rows, SCHEMA)
    got = judged(docs)
    assert got == sorted(((i, *x) for i, x in share.items()), key=str)
    assert got == brute_lines(rows)


def test_edited_copies_count_once(spark):
    """A group of a third of a host, words changed here and there: its lines stay."""
    chooser = random.Random(5)
    text = "\n".join(random_line(chooser, n) for n in (9, 60, 25, 40, 14))
    rows = [(i, random_line(chooser, 40), None, "a", None, None, None, None) for i in range(600)]
    rows += [(1_000 + i, edited(chooser, text, chooser.randint(1, 4)), None, "a", None, None, None, None) for i in range(300)]
    rows += [(2_000 + i, text, None, "a", None, None, None, None) for i in range(50)]
    rows += [(3_000 + i, None if i % 2 else "", None, None, None, None, None, None) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = judged(docs)
    assert got == brute_lines(rows)
    assert all(removed == 0 and kept for i, removed, kept in got if i < 3_000)


def test_rules_without_broadcast(spark, messy, messy_rows, monkeypatch):
    rows = messy_rows + [(900 + i, f"Every page says this line\nand this one too\n{make_text(900 + i, 24)}", None, f"s{i % 2}", None, None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_lines(rows)
    assert judged(docs) == want and any(removed for _, removed, _ in want)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOST_ROWS", 10)
    assert judged(docs) == want


def test_lines_of_many_documents_go_and_copies_count_once(spark):
    common_line = "This line is on every single page of the site we think\n"
    rows = [(i, common_line + ("own " + make_text(i) if i % 2 else f"only {i}"), None, "a", None, None, None, None) for i in range(40)]
    rows += [(100 + i, make_text(1), None, "a", None, None, None, None) for i in range(60)]  # copies stay
    rows += [(300 + i, common_line.split("\n")[0], None, "b", None, None, None, None) for i in range(5)]  # few on that host
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i in range(40) if i % 2} | set(range(100, 160)) | set(range(300, 305))


def test_documents_of_shared_lines_are_depleted(spark):
    chooser = random.Random(4)
    pool = [" ".join(make_words(900 + i, 8)) for i in range(20)]
    rows = [(i, "\n".join(chooser.sample(pool, 6)), None, "a", None, None, None, None) for i in range(2_000)]
    rows += [(5_000 + i, make_text(5_000 + i), None, "a", None, None, None, None) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in quality_rules.filtered(docs).collect()} == set(range(5_000, 5_100))
    assert judged(docs) == brute_lines(rows)


def test_kept_documents_lose_the_common_lines(spark):
    def own(i):
        return make_text(7_000 + i) + f"\n\n  Own   Line {i} "

    rows = [(i, f"Home |  About us\n{own(i)}\n home | about US", None, "a", None, None, None, None) for i in range(40)]
    rows += [(100 + i, f"Home | About us\n{own(100 + i)}", None, None, None, None, None, None) for i in range(5)]  # few on that host
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality_rules.filtered(docs)
    assert kept.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: own(i) for i in range(40)} | {100 + i: rows[40 + i][1] for i in range(5)}


def test_filtered_of_empty(empty):
    assert quality_rules.filtered(empty).collect() == []


def targets(sizes):
    """Water filling, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, found = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return found | share
        for s in over:
            found[s] = 2.0 * sizes[s]
            left -= found[s]
        open_ -= over
        if not open_:
            return found


def brute_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal = targets(sizes)
    result = []
    for source in sizes:
        own = [(len(WORD.findall(r[1] or "")), hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), str(r[0]), r) for r in rows if r[3] == source]
        own.sort(key=lambda x: x[:3])
        key = "b" if source is None else "a" + source
        u = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:8], 16) / 2**32
        rate = goal[source] / sizes[source] if sizes[source] else 0.0
        for k, (size, _, _, r) in enumerate(own, 1):
            copies = math.floor(u + rate * k) - math.floor(u + rate * (k - 1))
            result.append((r[0], size, sizes[source], round(goal[source], 6), copies * size))
    return sorted(result, key=str)


def test_mix_of_messy_rows(messy, messy_rows, empty, monkeypatch):
    def got():
        m = mixing.with_copies(messy)
        assert m.columns == [*messy.columns, "mix"]
        return sorted(((r["doc_id"], r["mix"]["size"], r["mix"]["source_size"], round(r["mix"]["target"], 6), r["mix"]["copies"] * r["mix"]["size"]) for r in m.collect()), key=str)

    assert got() == brute_mix(messy_rows)
    monkeypatch.setattr(mixing, "BLOCK", 2)  # cut blocks of one size further
    monkeypatch.setattr(mixing, "BLOCKS", 10**9)
    assert got() == brute_mix(messy_rows)
    assert mixing.with_copies(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_mixed_emits_copies(messy):
    copies = {}
    for r in mixing.with_copies(messy).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["mix"]["copies"]
    out = mixing.mixed(messy)
    assert out.columns == messy.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
