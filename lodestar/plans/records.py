"""Facts, change logs, consolidation, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import changes as c
from lodestar.operators import consolidation as k
from lodestar.operators import facts as f
from lodestar.operators import metrics as m
from lodestar.operators import vector_search as vs
from lodestar.plans.scans import BUCKET_SQL, DECAY_SQL
from lodestar.plans.vectors import asked, base, label_centres
from lodestar.sources.memories import EMBEDDED_SQL, FACTS_SQL, MEMORIES_SQL, NOW_MS, WAL_SQL, embedded, facts, memories, read, wal

REGISTERED: dict = {}
AT = 1_705_276_800_000  # 2024-01-15
DAY = 86_400_000


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


_UN = f"{FACTS_SQL}, un AS (SELECT * FROM fact WHERE fact_id NOT IN (SELECT retracts FROM fact WHERE retracts IS NOT NULL))"
_IDS = "fact_id, subject, predicate, object"


def _facts(**options):
    return lambda spark, sf_dir: f.query(facts(spark, sf_dir), **options).select("fact_id", "subject", "predicate", "object")


_add("facts_valid_at", _facts(valid_at=AT), f"WITH {_UN} SELECT {_IDS} FROM un WHERE valid_from <= {AT} AND valid_to > {AT}")
_add("facts_valid_during", _facts(valid_during=(AT, AT + DAY)), f"WITH {_UN} SELECT {_IDS} FROM un WHERE valid_from < {AT + DAY} AND valid_to > {AT}")
_add("facts_as_of", _facts(as_of=AT, valid_at=AT - DAY), f"WITH {_UN} SELECT {_IDS} FROM un WHERE tx_time <= {AT} AND valid_from <= {AT - DAY} AND valid_to > {AT - DAY}")
_add("facts_as_of_strict", _facts(as_of=AT, strict=True), f"WITH {FACTS_SQL} SELECT {_IDS} FROM fact WHERE tx_time <= {AT} AND fact_id NOT IN (SELECT retracts FROM fact WHERE retracts IS NOT NULL AND tx_time <= {AT})")
_add("facts_filtered", _facts(predicate="purchase", min_confidence=0.5, inferred=False), f"WITH {_UN} SELECT {_IDS} FROM un WHERE predicate = 'purchase' AND confidence >= 0.5 AND NOT inferred")
for _name, _keys in (("latest", "tx_time DESC, fact_id DESC"), ("confidence", "confidence DESC, fact_id DESC"), ("conflict", "confidence DESC, tx_time DESC, fact_id DESC")):
    _add(
        f"fact_winner_{_name}",
        lambda spark, sf_dir, name=_name: f.winners(f.query(facts(spark, sf_dir), as_of=AT), name).select("subject", "predicate", "fact_id"),
        f"WITH {_UN} SELECT subject, predicate, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY {_keys}) AS n FROM un WHERE tx_time <= {AT}) WHERE n = 1",
    )
_add(
    "fact_evidence",
    lambda spark, sf_dir: f.evidence(f.query(facts(spark, sf_dir), as_of=AT)),
    f"""WITH {_UN}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC, tx_time DESC, fact_id DESC) AS n FROM un WHERE tx_time <= {AT}),
      p AS (SELECT a.subject, a.predicate, a.fact_id, a.confidence AS w, b.confidence AS r, a.valid_from AS wf, b.valid_from AS rf FROM r a LEFT JOIN r b ON a.subject = b.subject AND a.predicate = b.predicate AND b.n = 2 WHERE a.n = 1)
      SELECT subject, predicate, fact_id, round(CASE WHEN r IS NULL THEN 0 ELSE 1 - least(greatest(w - r, 0), 1) END, 6) AS entropy,
        CASE WHEN r IS NULL THEN CASE WHEN w < 0.30::DOUBLE THEN 'ABSTAIN' ELSE 'ACCEPT_WINNER' END WHEN w < 0.30::DOUBLE AND r < 0.30::DOUBLE THEN 'ABSTAIN'
          WHEN w - r < 0.15::DOUBLE THEN 'ASK_CLARIFYING_QUESTION' WHEN wf <> rf THEN 'PRESENT_ALTERNATIVES' ELSE 'ACCEPT_WINNER' END AS policy FROM p""",
)
_add(
    "fact_history",
    lambda spark, sf_dir: f.history(facts(spark, sf_dir)),
    f"""WITH {FACTS_SQL} SELECT subject, predicate, (row_number() OVER w)::INT AS version, fact_id, lead(fact_id) OVER w AS superseded_by, fact_id IN (SELECT retracts FROM fact WHERE retracts IS NOT NULL) AS retracted
      FROM fact WINDOW w AS (PARTITION BY subject, predicate ORDER BY valid_from, fact_id)""",
)


def asserting(spark, sf_dir):
    """Facts from the middle of the month on asserted over those before."""
    rows = facts(spark, sf_dir).withColumn("valid_to", F.lit(f.OPEN))
    return f.asserted(rows.where(F.col("valid_from") < AT), rows.where(F.col("valid_from") >= AT), ("click",)).select("fact_id", "valid_from", "valid_to")


_add(
    "fact_assert",
    asserting,
    f"""WITH {FACTS_SQL}, s AS (SELECT subject, predicate, min(valid_from) AS b FROM fact WHERE valid_from >= {AT} AND predicate <> 'click' GROUP BY ALL)
      SELECT fact_id, valid_from, CASE WHEN valid_from < {AT} AND b IS NOT NULL AND b > valid_from THEN b ELSE 9223372036854775807 END AS valid_to FROM fact LEFT JOIN s USING (subject, predicate)""",
)
_add(
    "fact_weaving",
    lambda spark, sf_dir: f.woven(memories(spark, sf_dir).select("id", "ts_ms"), facts(spark, sf_dir)).select("id", "fact_id", "predicate"),
    f"WITH {FACTS_SQL}, {MEMORIES_SQL} SELECT mem.id, fact_id, predicate FROM mem JOIN fact ON subject = mem.id AND valid_from <= ts_ms AND ts_ms < valid_to",
)

# ---- change logs ---------------------------------------------------------------------

_add(
    "wal_replay",
    lambda spark, sf_dir: c.replayed(wal(spark, sf_dir), until_ms=AT),
    f"""WITH {WAL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY sequence DESC) AS n, count(*) OVER (PARTITION BY memory_id) AS changes FROM wal WHERE ts_ms <= {AT})
      SELECT memory_id, sequence, kind, ts_ms, payload, changes FROM r WHERE n = 1 AND kind <> 'FORGET'""",
)
_add(
    "wal_time_travel",
    lambda spark, sf_dir: c.replayed(wal(spark, sf_dir), after=100, most=500),
    f"""WITH {WAL_SQL}, l AS (SELECT * FROM wal WHERE sequence > 100 ORDER BY sequence LIMIT 500), r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY sequence DESC) AS n, count(*) OVER (PARTITION BY memory_id) AS changes FROM l)
      SELECT memory_id, sequence, kind, ts_ms, payload, changes FROM r WHERE n = 1 AND kind <> 'FORGET'""",
)
_add("wal_truncate", lambda spark, sf_dir: c.truncated(wal(spark, sf_dir), 500).groupBy("kind").agg(F.count("*").alias("n"), F.min("sequence").alias("first")), f"WITH {WAL_SQL} SELECT kind, count(*) AS n, min(sequence) AS first FROM wal WHERE sequence >= 500 GROUP BY kind")
_HEAD = ("id", "ts_ms", "tag_mask", "importance", "agent_recalls", "valence", "tombstoned", "pinned")


def replicas(spark, sf_dir):
    local = memories(spark, sf_dir).select(*_HEAD)
    remote = local.select((F.col("id") + 10).alias("id"), (F.col("ts_ms") + 5000 - (F.col("id") % 3) * 36_005_000).alias("ts_ms"), "tag_mask", "importance", "agent_recalls", "valence", "tombstoned", "pinned")
    return local, remote


_REP = f"{MEMORIES_SQL}, l AS (SELECT * FROM mem), r AS (SELECT id + 10 AS id, ts_ms + 5000 - (id % 3) * 36005000 AS ts_ms, tag_mask, importance, agent_recalls, valence, tombstoned, pinned FROM mem)"
_add(
    "crdt_merge",
    lambda spark, sf_dir: c.merged(*replicas(spark, sf_dir)),
    f"""WITH {_REP} SELECT coalesce(l.id, r.id) AS id, greatest(l.ts_ms, r.ts_ms) AS ts_ms, coalesce(l.tag_mask, 0) | coalesce(r.tag_mask, 0) AS tag_mask, greatest(l.importance, r.importance) AS importance,
      greatest(l.agent_recalls, r.agent_recalls) AS agent_recalls, CASE WHEN r.id IS NOT NULL AND (l.id IS NULL OR r.ts_ms >= l.ts_ms) THEN r.valence ELSE l.valence END AS valence,
      coalesce(l.tombstoned, false) OR coalesce(r.tombstoned, false) AS tombstoned, coalesce(l.pinned, false) OR coalesce(r.pinned, false) AS pinned FROM l FULL JOIN r ON l.id = r.id""",
)
_add(
    "crdt_would_change",
    lambda spark, sf_dir: c.would_change(*replicas(spark, sf_dir)),
    f"""WITH {_REP} SELECT l.id, r.ts_ms > l.ts_ms OR r.importance > l.importance OR r.agent_recalls > l.agent_recalls OR (r.tag_mask & ~l.tag_mask) <> 0
      OR (r.tombstoned AND NOT l.tombstoned) OR (r.pinned AND NOT l.pinned) AS change FROM l JOIN r ON l.id = r.id""",
)
_add("tombstone_ratios", lambda spark, sf_dir: c.tombstone_ratios(memories(spark, sf_dir), 0.05), f"WITH {MEMORIES_SQL} SELECT memory_type, round(avg(tombstoned::INT), 6) AS ratio, count(*) AS n, avg(tombstoned::INT) >= 0.05 AS compact FROM mem GROUP BY memory_type")
_add("vacuum", lambda spark, sf_dir: c.vacuumed(memories(spark, sf_dir)).select("id", "memory_type"), f"WITH {MEMORIES_SQL} SELECT id, memory_type FROM mem WHERE NOT tombstoned")
_add(
    "forget",
    lambda spark, sf_dir: c.forgotten(memories(spark, sf_dir), read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))).select("id", "tombstoned"),
    f"WITH {MEMORIES_SQL} SELECT id, tombstoned OR id IN (SELECT user_id FROM events WHERE event_type = 'error') AS tombstoned FROM mem",
)


def remember(spark, sf_dir):
    """What the events would add to the users known by conversations, each id once."""
    stored = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    new = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("text"))
    return c.remembered(stored, new)


_add("remember_once", remember, "SELECT user_id AS id, min(event_type) AS text FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations) GROUP BY user_id")


def changed_chunks(spark, sf_dir):
    """Paragraphs of documents against a version in which every third has changed."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("chunk", "text"))
    old = rows.withColumn("text", F.when((F.col("doc_id") + F.col("chunk")) % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return c.unchanged_skipped(old, rows).select("doc_id", "chunk")


_add(
    "unchanged_chunk_skip",
    changed_chunks,
    "SELECT doc_id, (i - 1)::INT AS chunk FROM (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents) WHERE (doc_id + i - 1) % 3 = 0",
)
_add("daily_statistics", lambda spark, sf_dir: c.daily_maximum(read(spark, sf_dir, "events"), "ts", "value"), "SELECT ts::DATE AS day, max(value) AS largest, count(*) AS n FROM events GROUP BY 1")
_add("export_json", lambda spark, sf_dir: c.exported(memories(spark, sf_dir).select("id", "memory_type", "valence", "tombstoned")), f"""WITH {MEMORIES_SQL} SELECT id, '{{"id":' || id || ',"memory_type":"' || memory_type || '","valence":' || valence || '}}' AS json FROM mem WHERE NOT tombstoned""")

# ---- consolidation -------------------------------------------------------------------

_AGED = f"{MEMORIES_SQL}, ag AS (SELECT *, {NOW_MS} - ts_ms AS age FROM mem), bu AS (SELECT *, {BUCKET_SQL} >> least(agent_recalls, 5) AS b FROM ag)"
_add(
    "synaptic_pruning",
    lambda spark, sf_dir: k.pruned(memories(spark, sf_dir), NOW_MS, 2.0).select("id", "tombstoned"),
    f"WITH {_AGED} SELECT id, tombstoned OR (importance * {DECAY_SQL.format(b='b')} < 2 AND NOT pinned) AS tombstoned FROM bu",
)
_add(
    "session_consolidation",
    lambda spark, sf_dir: k.sessions_joined(read(spark, sf_dir, "conversations"), "conv_id", ("turn", "role"), "text"),
    "SELECT conv_id, count(*) AS turns, left(string_agg(left(coalesce(text, ''), 500), ' ' ORDER BY turn, role, left(coalesce(text, ''), 500)), 500) AS text FROM conversations GROUP BY conv_id",
)
_add("procedural_crystallisation", lambda spark, sf_dir: k.crystallized(read(spark, sf_dir, "conversations"), "conv_id"), "SELECT conv_id, count(*) AS steps, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
_CEN = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), cen AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i) GROUP BY label), ce AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, m FROM cen)"
_add(
    "cluster_and_promote",
    lambda spark, sf_dir: k.clustered(embedded(spark, sf_dir), label_centres(spark, sf_dir)),
    f"""WITH {EMBEDDED_SQL}, {_CEN}, a AS (SELECT emb.id, arg_min(cell, list_distance(vector, m)) AS cell FROM emb, ce GROUP BY emb.id)
      SELECT cell::INT AS cell, count(*) AS members, (first(id ORDER BY importance DESC, id)) AS id, bit_and(tag_mask) AS tag_mask FROM emb JOIN a USING (id) GROUP BY cell HAVING count(*) >= 5""",
)
_R = 1.1
_PAIRS = f"{EMBEDDED_SQL}, pr AS (SELECT x.id AS a, y.id AS b, x.ts_ms AS ta, y.ts_ms AS tb FROM emb x JOIN emb y ON x.id < y.id WHERE list_distance(x.vector, y.vector) <= 0.3)"
_add(
    "proactive_interference",
    lambda spark, sf_dir: k.interfered(embedded(spark, sf_dir), 0.3, label_centres(spark, sf_dir)).select("id", F.round("importance", 6).alias("importance")),
    f"WITH {_PAIRS}, o AS (SELECT DISTINCT CASE WHEN ta <= tb THEN a ELSE b END AS id FROM pr) SELECT id, round(CASE WHEN id IN (SELECT id FROM o) THEN importance * 0.7::DOUBLE ELSE importance END, 6) AS importance FROM emb",
)
_add(
    "semantic_dedup",
    lambda spark, sf_dir: k.merged_duplicates(embedded(spark, sf_dir), 0.3, label_centres(spark, sf_dir)).select("kept", "n", F.round("importance", 6).alias("importance"), "tag_mask", "ts_ms"),
    f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
      reach AS (SELECT a, a AS b FROM w UNION SELECT reach.a, w.b FROM reach JOIN w ON reach.b = w.a), g AS (SELECT a AS id, min(b) AS kept FROM reach GROUP BY a)
      SELECT kept, count(*) AS n, round(max(importance), 6) AS importance, bit_or(tag_mask) AS tag_mask, max(ts_ms) AS ts_ms FROM g JOIN emb ON g.id = emb.id GROUP BY kept""",
)
_add("bulk_decay", lambda spark, sf_dir: k.bulk_decayed(memories(spark, sf_dir), NOW_MS, 10 * DAY, 0.5).select("id", F.round("importance", 6).alias("importance")), f"WITH {MEMORIES_SQL} SELECT id, round(CASE WHEN {NOW_MS} - ts_ms > {10 * DAY} THEN importance * 0.5 ELSE importance END, 6) AS importance FROM mem")
_add("temporal_pruning", lambda spark, sf_dir: k.retained(memories(spark, sf_dir), NOW_MS, 20 * DAY).select("id"), f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE {NOW_MS} - ts_ms <= {20 * DAY} AND importance >= 1")


def contradictions(spark, sf_dir):
    rows = memories(spark, sf_dir).select("id", "ts_ms", "strength")
    first = rows.select(F.col("id").alias("a"), F.col("ts_ms").alias("a_ts"), F.col("strength").alias("a_strength"))
    second = rows.select((F.col("id") - 7).alias("a"), F.col("id").alias("b"), (F.col("ts_ms") + (F.col("id") % 3) * 12_600_000).alias("b_ts"), F.col("strength").alias("b_strength"))
    return k.contradiction_winner(first.join(second, "a"))


_add(
    "contradiction_winner",
    contradictions,
    f"""WITH {MEMORIES_SQL}, p AS (SELECT x.id AS a, y.id AS b, x.ts_ms AS t, y.ts_ms + (y.id % 3) * 12600000 AS u, x.strength AS s, y.strength AS r FROM mem x JOIN mem y ON y.id = x.id + 7),
      w AS (SELECT a, b, t > u OR (t = u AND (s > r OR (s = r AND a < b))) AS f FROM p) SELECT a, b, CASE WHEN f THEN a ELSE b END AS winner, CASE WHEN f THEN b ELSE a END AS loser FROM w""",
)
_add(
    "reminders_due",
    lambda spark, sf_dir: k.reminders_due(memories(spark, sf_dir).select("id", (F.col("ts_ms") + 15 * DAY).alias("trigger_ms")), NOW_MS).select("id", "score"),
    f"WITH {MEMORIES_SQL} SELECT id, 10::DOUBLE AS score FROM mem WHERE ts_ms + {15 * DAY} <= {NOW_MS}",
)
_add(
    "drift_refusion",
    lambda spark, sf_dir: k.refused(memories(spark, sf_dir).select("id", (F.col("id") % 4).alias("version"), ((F.col("id") * 13 % 101) / 25.0).alias("surprise")), 3, 50).select("id", F.round("importance", 6).alias("importance"), F.col("version").cast("int").alias("version")),
    f"""WITH {MEMORIES_SQL}, s AS (SELECT id, (id * 13 % 101) / 25 AS z FROM mem WHERE id % 4 < 3 ORDER BY z DESC, id LIMIT 50) SELECT id, round(0.05::DOUBLE + 9.95::DOUBLE / (1 + exp(-1.2::DOUBLE * (z - 1))), 6) AS importance, 3 AS version FROM s""",
)
_add(
    "cross_layer_promotion",
    lambda spark, sf_dir: k.promoted(__import__("lodestar.plans.graphs", fromlist=["edges"]).edges(spark, sf_dir).where("src < dst")).select("src", "dst", F.round("boost", 6).alias("boost")),
    "WITH " + __import__("lodestar.plans.graphs", fromlist=["EDGES"]).EDGES + " SELECT src, dst, round(least(weight * 0.05::DOUBLE, 0.3), 6) AS boost FROM ed WHERE src < dst AND weight >= 3",
)


def eager(spark, sf_dir):
    rows = base(spark, sf_dir)
    return k.eager(rows.where("id % 20 = 0"), rows.where("id % 20 <> 0"), _R, label_centres(spark, sf_dir)).select("new", "old", F.round("distance", 5).alias("distance"))


_add(
    "eager_consolidation",
    eager,
    f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT x.id AS "new", y.id AS old, list_distance(x.v, y.v) AS g FROM e x, e y WHERE x.id % 20 = 0 AND y.id % 20 <> 0 AND list_distance(x.v, y.v) <= {_R})
      SELECT "new", old, round(g, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY "new" ORDER BY g, old) AS n FROM d) WHERE n = 1""",
)
_add(
    "reflect",
    lambda spark, sf_dir: k.reflected(memories(spark, sf_dir), NOW_MS, 30 * DAY).select("id", F.round("importance", 6).alias("importance")),
    f"""WITH {_AGED}, d AS (SELECT id, age, CASE WHEN age > {15 * DAY} THEN importance * 0.9::DOUBLE ELSE importance END AS i FROM bu WHERE NOT tombstoned AND NOT (importance * {DECAY_SQL.format(b='b')} < 0.05 AND NOT pinned))
      SELECT id, round(i, 6) AS importance FROM d WHERE age <= {30 * DAY} AND i >= 0.5""",
)

# ---- metrics -------------------------------------------------------------------------


def judged(spark, sf_dir):
    rows = base(spark, sf_dir).select("id", "label")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label")
    return queries.join(rows, "label").select("query_id", "id", F.lit(1).alias("grade"))


def retrieval(spark, sf_dir, metric="cosine"):
    return m.ranking_metrics(vs.top_k(base(spark, sf_dir), asked(spark, sf_dir), 10, metric).select("query_id", "id", "rank"), judged(spark, sf_dir))


_RANK = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), x AS (SELECT q.id AS query_id, e.id, q.label = e.label AS g, round(list_cosine_similarity(q.v, e.v), 6) AS s FROM e q, e WHERE q.id % 20 = 0),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM x) WHERE rank <= 10), n AS (SELECT query_id, count(*) AS n FROM x WHERE g GROUP BY query_id),
  met AS (SELECT r.query_id, sum(g::INT / log2(rank + 1)) AS dcg, min(CASE WHEN g THEN rank END) AS f, sum(g::INT) AS h, any_value(n) AS n FROM r JOIN n USING (query_id) GROUP BY r.query_id)"""
_add(
    "retrieval_metrics",
    retrieval,
    f"WITH {_RANK} SELECT query_id, round(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(n, 10) + 1)]), 6) AS ndcg, round(coalesce(1 / f, 0), 6) AS mrr, round(h / n, 6) AS recall FROM met",
)
_add(
    "paired_statistics",
    lambda spark, sf_dir: m.paired_test(read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("y")), "x", "y").select("n", F.round("cohens_d", 4).alias("cohens_d"), F.round("z", 2).alias("z")),
    """WITH g AS (SELECT l_extendedprice * (1 - l_discount) - l_extendedprice * (1 - l_tax) AS g FROM lineitem), a AS (SELECT count(*) AS n, avg(g) AS m, stddev_samp(g) AS s FROM g)
      SELECT n, round(m / s, 4) AS cohens_d, round(m / (s / sqrt(n)), 2) AS z FROM a""",
)
