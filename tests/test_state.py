"""State that outlives its objects: journals, stores, streams; entities and work policies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import consolidation, entities, lexical, policies, vector_search
from lodestar.sources import files, lineage, sinks
from lodestar.sources.journal import Journal
from lodestar.streaming import streams

SCHEMA = "id long, v string"


def state(journal):
    return {r["id"]: r["v"] for r in journal.rows().collect()}


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    journal = Journal(spark, path, SCHEMA)
    assert state(journal) == {} and journal.version() == 0
    journal.put(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], SCHEMA))
    journal.put(spark.createDataFrame([(2, "c")], SCHEMA))
    journal.drop(spark.createDataFrame([(1,)], "id long"))
    assert state(journal) == {2: "c", 3: None} and journal.version() == 3
    again = Journal(spark, path, SCHEMA)  # another object, the same state
    assert state(again) == {2: "c", 3: None}
    again.compact()
    again.put(spark.createDataFrame([(1, "z")], SCHEMA))
    assert state(Journal(spark, path, SCHEMA)) == {1: "z", 2: "c", 3: None}
    assert lineage.committed(spark, path) == ["base-4", "change-5"]
    (tmp_path / "j" / "change-6").mkdir()  # a write that failed
    assert state(again) == {1: "z", 2: "c", 3: None}
    again.put(spark.createDataFrame([(9, "n")], SCHEMA))
    assert state(again)[9] == "n"
    again.drop(spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long"))
    assert state(again) == {}


def test_engine_opens_its_folder_again(spark, tmp_path):
    from lodestar.engine import MemoryEngine

    path = str(tmp_path / "engine")
    engine = MemoryEngine(spark, path, files.hashed_embedder(16), now_ms=lambda: 10**12)
    engine.remember(spark.createDataFrame([(1, "red apples"), (2, "blue skies")], "id long, text string"))
    again = MemoryEngine(spark, path, files.hashed_embedder(16), now_ms=lambda: 10**12)
    assert again.status() == {"EPISODIC": 2} and again.version == 1
    again.forget(2)
    again.pin(1)
    third = MemoryEngine(spark, path, files.hashed_embedder(16), now_ms=lambda: 10**12)
    assert third.status() == {"EPISODIC": 1} and third.inspect(1)["pinned"] and third.version == 3
    # A change writes the rows that it concerns, not the table.
    assert spark.read.parquet(f"{path}/memories/change-2").count() == 1
    third.vacuum()
    assert MemoryEngine(spark, path, files.hashed_embedder(16)).memories().count() == 1


def test_vector_store_opens_its_folder_again(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = "id long, text string, metadata map<string,string>"
    sinks.VectorStore(spark, path, files.hashed_embedder(32)).add(spark.createDataFrame([(1, "red apples", {"k": "a"}), (2, "blue skies", None)], rows))
    store = sinks.VectorStore(spark, path, files.hashed_embedder(32))
    store.delete([2])
    store.compact()
    assert [r["id"] for r in sinks.VectorStore(spark, path, files.hashed_embedder(32)).search("red apples").collect()] == [1]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, event_id long"
    want = {}
    for k in range(20):  # beyond a folded table
        rows = [(u, 100 * k + u) for u in range(k % 5 + 1)]
        want |= dict(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k in (0, 7, 19):  # each time a query of its own, as by another driver
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            got = streams.upserted(spark, stream, folder)
            assert {r["user_id"]: r["event_id"] for r in got.collect()} == want


def test_drained_modes(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(u, float(k)) for u in range(4)], "user_id long, value double").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("user_id long, value double").option("maxFilesPerTrigger", 1).parquet(source)
    assert streams.drained(spark, stream(), "append").count() == 12
    seen = streams.drained(spark, streams.habituation(stream()), "update", ("user_id",))
    assert {(r["user_id"], r["n"]) for r in seen.collect()} == {(u, 3) for u in range(4)}
    total = streams.drained(spark, stream().groupBy("user_id").agg(F.sum("value").alias("t")), "complete")
    assert {(r["user_id"], r["t"]) for r in total.collect()} == {(u, 3.0) for u in range(4)}
    assert streams.drained(spark, stream().where("value > 9"), "append").count() == 0


def test_search_beyond_the_query_bound(spark, monkeypatch):
    """Blocks of queries and of rows meet by both numbers; the result is the same."""
    random = np.random.default_rng(1)
    x = random.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, vector array<double>, cell int")
    queries = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector", "cell")
    for cells in (None, "cell"):
        want = sorted(map(tuple, vector_search.top_k(rows, queries, 4, "l2", cells=cells).collect()))
        with monkeypatch.context() as patched:
            patched.setattr(vector_search, "QUERY_BYTES", 0)
            patched.setattr(vector_search, "BLOCK", 64)
            patched.setattr(vector_search, "QUERIES", 4)
            found = vector_search.top_k(rows, queries, 4, "l2", cells=cells)
            assert sorted(map(tuple, found.collect())) == want


def test_near_pairs_in_blocks(spark, monkeypatch):
    random = np.random.default_rng(3)
    x = random.normal(size=(150, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    got = [(r["a"], r["b"]) for r in vector_search.near_pairs(rows, 0.7, random.normal(size=(4, 3))).collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert sorted(got) == [(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.7]


def test_equal_frequencies_are_exact(spark):
    """More values than approximate quantiles tell apart, ties, nulls; buckets by plain ranks."""
    random = np.random.default_rng(8)
    x = np.stack([random.normal(size=40_000), random.integers(0, 5, 40_000), np.arange(40_000.0)], axis=1)
    rows = spark.createDataFrame([(i, [None if k % 3 == 0 and i < 7 else float(v) for k, v in enumerate(r)]) for i, r in enumerate(x)], "id long, vector array<double>")
    got = {(r["d"], r["code"]): (r["n"], r["centre"]) for r in vector_search.equal_frequency(rows).collect()}
    want = {}
    for d in range(3):
        own, nulls = np.sort(x[7 if d == 0 else 0 :, d]), 7 * (d == 0)
        cuts = own[[-(-len(own) * i // 16) - 1 for i in range(1, 16)]]
        codes = (own[:, None] > cuts).sum(axis=1)
        for code in np.unique(codes):
            want[d, int(code)] = (int((codes == code).sum()) + nulls * int(code == 0), own[codes == code].mean())
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - centre) < 1e-9 for k, (_, centre) in want.items())


def crowded(spark):
    """Rows of equal, near and far vectors, with tied times, and the pairs within 0.7."""
    random = np.random.default_rng(5)
    x = random.normal(size=(160, 3)) * 2
    x[100:130] = x[7] + random.normal(size=(30, 3)) * 0.05
    x[130:150] = x[random.integers(0, 30, 20)]
    x[150:155] = np.nan
    times = random.integers(0, 40, 160)
    data = [(i, [float(v) for v in r], float(i % 9), 1 << i % 5, int(times[i])) for i, r in enumerate(x)] + [(160, None, 1.0, 1, 3)]
    rows = spark.createDataFrame(data, "id long, vector array<double>, importance double, tag_mask long, ts_ms long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return rows, times, [(i, j) for i in range(160) for j in range(i + 1, 160) if d[i, j] <= 0.7]


@pytest.mark.parametrize("wide", [False, True])
def test_consolidation_without_lists_of_pairs(spark, monkeypatch, wide):
    """Groups of blocks against all pairs; links are fewer than rows, whatever the pairs."""
    rows, times, pairs = crowded(spark)
    if not wide:
        monkeypatch.setattr(vector_search, "BLOCK", 16)
        monkeypatch.setattr(vector_search, "WIDE", 40)
        monkeypatch.setattr(vector_search, "TILE", 8)
    centres = np.random.default_rng(6).normal(size=(3, 3))
    group = list(range(160))
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    older = {a if times[a] <= times[b] else b for a, b in pairs}
    got = {r["id"]: r["importance"] for r in consolidation.interfered(rows, 0.7, centres).collect()}
    assert got == {i: (i % 9 if i < 160 else 1.0) * (0.7 if i in older else 1) for i in range(161)}
    members = {g: [i for i in range(160) if group[i] == g] for g in set(group)}
    found = {r["kept"]: tuple(r)[1:] for r in consolidation.merged_duplicates(rows, 0.7, centres).collect()}
    want = {g: (len(m), max(float(i % 9) for i in m), int(np.bitwise_or.reduce([1 << i % 5 for i in m])), max(int(times[i]) for i in m)) for g, m in members.items() if len(m) > 1}
    assert found == want
    if wide:
        links = sorted(map(tuple, vector_search.near_links(rows, 0.7, centres).collect()))
        assert len(links) < 3 * 160 < len(pairs)
        again = rows.repartition(3, F.col("id") % 7).sortWithinPartitions(F.desc("id"))
        assert sorted(map(tuple, vector_search.near_links(again, 0.7, centres).collect())) == links


def test_duplicate_groups_are_disjoint(spark):
    rows = spark.createDataFrame([(1, [0.0], 1.0, 1, 5), (2, [0.9], 3.0, 2, 9), (3, [1.8], 2.0, 4, 7), (4, [9.0], 1.0, 8, 1), (5, [9.5], 4.0, 16, 2), (6, [50.0], 1.0, 1, 1)], "id long, vector array<double>, importance double, tag_mask long, ts_ms long")
    found = {r["kept"]: tuple(r)[1:] for r in consolidation.merged_duplicates(rows, 1.0, np.array([[0.0], [9.0]])).collect()}
    assert found == {1: (3, 3.0, 7, 9), 4: (2, 4.0, 24, 2)}


def test_entities(spark):
    links = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.4), (2, 11, 1.0), (3, 11, 1.0), (4, 12, 1.0)], "entity long, memory long, weight double")
    merges = spark.createDataFrame([(2, 1), (3, 2)], "entity long, into long")
    assert sorted(map(tuple, entities.resolved(merges).collect())) == [(2, 1), (3, 1)]
    got = {(r["entity"], r["memory"]): round(r["weight"], 6) for r in entities.merged_links(links, merges).collect()}
    assert got == {(1, 10): 1.2, (1, 11): 1.2, (4, 12): 1.0}
    undone = entities.unmerged(merges, spark.createDataFrame([(2,)], "entity long"))
    assert sorted(map(tuple, entities.resolved(undone).collect())) == [(3, 2)]
    assert {r["entity"] for r in entities.decayed_links(links, 0.9, 1.0).collect()} == {2}
    named = spark.createDataFrame([(7, " Ann ", "P"), (3, "ann", ""), (4, " ", "P"), (5, None, "P")], "memory long, name string, type string")
    assert [tuple(r) for r in entities.interned(named).collect()] == [(3, "ann", "OTHER")]
    alike = spark.createDataFrame([(1, "longer", "p", [1.0, 0.0]), (2, "short", "p", [0.99, float(np.sqrt(1 - 0.99**2))]), (3, "x", "q", [1.0, 0.0])], "id long, name string, type string, vector array<double>")
    assert [(r["keep"], r["drop"]) for r in entities.similar_entities(alike, np.array([[1.0, 0.0]])).collect()] == [(2, 1)]
    assert entities.similar_entities(alike, np.array([[1.0, 0.0]]), adjudicate=lambda pairs: pairs.limit(0)).collect() == []


def test_policies(spark):
    tasks = spark.createDataFrame([("q", i, i % 2) for i in range(6)], "queue string, sequence long, priority int")
    order = lambda policy: [r["sequence"] for r in policies.admitted(tasks, 3, policy).orderBy("place", "sequence").collect()]
    assert order("REJECT_FAST") == [1, 0, 2] and order("DROP_OLDEST") == [3, 5, 4] and order("CALLER_RUNS") == [3, 4, 5, 1, 0, 2]
    with pytest.raises(ValueError):
        policies.admitted(tasks, 3, "NOPE")
    events = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "event_id long, type string, scope string")
    wanted = spark.createDataFrame([("x", "*", None), ("x", "a", "s"), ("y", "b", "s")], "subscriber string, type string, scope string")
    assert sorted(map(tuple, policies.delivered(events, wanted).collect())) == [("x", 1, "a"), ("x", 2, "b")]
    stages = {"A": spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.4)], "query_id long, id long, score double"), "B": spark.createDataFrame([(1, 5, 0.25)], "query_id long, id long, score double")}
    steps = {r["id"]: [(s["phase"], s["score_before"], s["score_after"], s["candidates_before"], s["candidates_after"]) for s in r["steps"]] for r in policies.traced(stages).collect()}
    assert steps == {5: [("A", None, 0.5, 0, 2), ("B", 0.5, 0.25, 2, 1)], 6: [("A", None, 0.4, 0, 2), ("B", 0.4, None, 2, 1)]}


def test_keyword_index_opens_again(spark, tmp_path):
    path = str(tmp_path / "k")
    rows = spark.createDataFrame([(1, "red apples grow"), (2, "blue skies"), (3, "apples apples red")], "id long, text string")
    queries = spark.createDataFrame([(0, "red apples")], "query_id long, text string")
    lexical.KeywordIndex(spark, path).upsert(rows)
    index = lexical.KeywordIndex(spark, path)
    key = lambda found: [(r["id"], r["score"]) for r in found.orderBy("rank").collect()]
    assert key(index.search(queries)) == key(lexical.bm25(rows, queries))
    index.remove(spark.createDataFrame([(3,)], "id long"))
    index.upsert(spark.createDataFrame([(2, "red sky")], "id long, text string"))
    index.compact()
    now = spark.createDataFrame([(1, "red apples grow"), (2, "red sky")], "id long, text string")
    assert key(lexical.KeywordIndex(spark, path).search(queries)) == key(lexical.bm25(now, queries))


def test_index_recall(spark):
    import __spark_entry__

    found = {r["index"]: r["recall"] for r in __spark_entry__.queries()["index_recall"](spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 4 and min(found.values()) >= 0.9


def test_engine_facts_notes_and_replicas(spark, tmp_path):
    from lodestar.engine import MemoryEngine

    clock = [1_000]
    new = lambda name: MemoryEngine(spark, str(tmp_path / name), files.hashed_embedder(16), now_ms=lambda: clock[0])
    engine, other = new("a"), new("b")
    facts_ = lambda *rows: spark.createDataFrame(list(rows), "fact_id long, subject long, predicate string, object long")
    engine.assert_facts(facts_((1, 7, "lives_in", 100), (2, 100, "part_of", 200)))
    clock[0] = 2_000
    engine.assert_facts(facts_((3, 7, "lives_in", 101)))
    again = new("a")
    assert {r["fact_id"] for r in again.facts(valid_at=1_500).collect()} == {1, 2} and {r["fact_id"] for r in again.facts(valid_at=2_500).collect()} == {2, 3}
    assert {(r["fact_id"], r["superseded_by"]) for r in again.fact_history().where("predicate = 'lives_in'").collect()} == {(1, 3), (3, None)}
    assert {tuple(r["nodes"]) for r in again.graph_recall(7).collect()} >= {(7, 100), (7, 101), (7, 100, 200)}
    again.retract(3, by=4)
    assert 3 not in {r["fact_id"] for r in again.facts().collect()}
    engine.note("plan", "buy apples")
    engine.note("old", "x")
    engine.note("old", None)
    assert new("a").notes() == {"plan": "buy apples"}
    engine.remember(spark.createDataFrame([(1, "red apples", 5), (2, "blue skies", 5)], "id long, text string, session_id long"))
    engine.remind(1, 1_500)
    engine.remind(2, 9_000)
    assert [(r["id"], r["text"]) for r in engine.reminders_due().collect()] == [(1, "red apples")]
    other.remember(spark.createDataFrame([(2, "blue skies", 5), (3, "sour grapes", 6)], "id long, text string, session_id long"))
    other.forget(2)
    assert {r["id"]: r["change"] for r in engine.would_change(other).collect()} == {2: True}
    engine.merge_from(other)
    assert engine.status() == {"EPISODIC": 2} and engine.inspect(2)["tombstoned"] and engine.inspect(3)["text"] == "sour grapes"
    assert [r["id"] for r in engine.session(5).collect()] == [1] and [r["id"] for r in engine.unresolved().collect()] == [1, 3]
    engine.export_bundle(str(tmp_path / "bundle"))
    third = new("c")
    third.import_bundle(str(tmp_path / "bundle"))
    assert third.status() == {"EPISODIC": 2} and third.facts().count() == engine.facts().count()
    assert third.replay().count() == 2 and third.tombstone_ratios().count() == 1 and third.consolidation_due(0).first()["changes"] == 3


def test_written_tables_can_be_swept(spark, tmp_path):
    lineage._MADE.clear()
    path = lineage.shared_folder(spark, "swept")
    spark.range(3).write.parquet(path)
    assert lineage.swept(spark) == 1 and lineage.swept(spark) == 0
    assert lineage.committed(spark, path.rsplit("/", 1)[0]).count(path.rsplit("/", 1)[1]) == 0


def test_groups_are_bounded(spark, monkeypatch):
    from lodestar.operators import recall

    rows = spark.createDataFrame([(1, i, 1.0, [float(i), 1.0]) for i in range(6)], "query_id long, id long, score double, vector array<double>")
    assert recall.mmr(rows, 3).count() == 3
    monkeypatch.setattr(recall, "GROUP", 5)
    for call in (lambda: recall.mmr(rows, 3), lambda: recall.integrated_information(rows.withColumnRenamed("query_id", "group_id"))):
        with pytest.raises(ValueError, match="more than 5"):
            call()
