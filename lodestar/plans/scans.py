"""Scans, filters, point lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import gates as g
from lodestar.sources.memories import MEMORIES_SQL, NOW_MS, memories, read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


def _mem(sql: str) -> str:
    return f"WITH {MEMORIES_SQL} {sql}"


IDS = ("id", "memory_type", "ts_ms")


def tier_scan(spark, sf_dir):
    return g.gated(memories(spark, sf_dir), g.Gates(memory_types=("EPISODIC", "SEMANTIC")), NOW_MS).select(*IDS)


_add("tier_scan", tier_scan, _mem("SELECT id, memory_type, ts_ms FROM mem WHERE memory_type IN ('EPISODIC', 'SEMANTIC') AND NOT tombstoned AND NOT contradicted"))

_GATES = {
    "gate_tombstone": (g.Gates(include_contradicted=True), "NOT tombstoned"),
    "gate_contradiction": (g.Gates(include_tombstoned=True), "NOT contradicted"),
    "gate_temporal": (g.Gates(include_tombstoned=True, include_contradicted=True, min_ts_ms=NOW_MS - 400 * 3_600_000, max_ts_ms=NOW_MS - 20 * 3_600_000), f"ts_ms BETWEEN {NOW_MS - 400 * 3_600_000} AND {NOW_MS - 20 * 3_600_000}"),
    "gate_hyperfocus": (g.Gates(include_tombstoned=True, include_contradicted=True, all_tags=1 | 1 << 5), "(tag_mask & 33) = 33"),
    "gate_synaptic_tags": (g.Gates(include_tombstoned=True, include_contradicted=True, any_tags=2 | 1 << 6), "(tag_mask & 66) <> 0"),
    "gate_valence": (g.Gates(include_tombstoned=True, include_contradicted=True, min_valence=-20, max_valence=90), "valence BETWEEN -20 AND 90"),
    "gate_importance": (g.Gates(include_tombstoned=True, include_contradicted=True, min_importance=4.5), "importance >= 4.5::DOUBLE"),
    "gate_deep_sleep": (g.Gates(include_tombstoned=True, include_contradicted=True, deep_sleep=True), f"NOT ({NOW_MS + 43_500 * 3_600_000} - ts_ms >= 157680000000 AND importance < 1 AND NOT pinned AND resolved)"),
}
for _name, (_gate, _where) in _GATES.items():
    _now = NOW_MS + 43_500 * 3_600_000 if _name == "gate_deep_sleep" else NOW_MS
    _add(_name, lambda spark, sf_dir, gate=_gate, now=_now: g.gated(memories(spark, sf_dir), gate, now).select(*IDS), _mem(f"SELECT id, memory_type, ts_ms FROM mem WHERE {_where}"))

ALL_GATES = g.Gates(("SEMANTIC", "EPISODIC", "WORKING"), False, False, NOW_MS - 9000 * 3_600_000, NOW_MS, None, 3, -100, 120, 0.5, True)
_add(
    "gates_together",
    lambda spark, sf_dir: g.gated(memories(spark, sf_dir), ALL_GATES, NOW_MS).select(*IDS),
    _mem(f"""SELECT id, memory_type, ts_ms FROM mem WHERE memory_type IN ('SEMANTIC', 'EPISODIC', 'WORKING') AND NOT tombstoned AND NOT contradicted
      AND ts_ms BETWEEN {NOW_MS - 9000 * 3_600_000} AND {NOW_MS} AND (tag_mask & 3) <> 0 AND valence BETWEEN -100 AND 120 AND importance >= 0.5::DOUBLE"""),
)
_add(
    "gate_counts",
    lambda spark, sf_dir: g.gate_counts(memories(spark, sf_dir), g.Gates(("SEMANTIC",), min_valence=0, min_importance=5.0, any_tags=1), NOW_MS),
    _mem("""SELECT unnest(['tier', 'tombstone', 'contradiction', 'tags', 'valence_from', 'importance']) AS gate,
      unnest([sum((memory_type = 'SEMANTIC')::BIGINT), sum((NOT tombstoned)::BIGINT), sum((NOT contradicted)::BIGINT), sum(((tag_mask & 1) <> 0)::BIGINT),
              sum((valence >= 0)::BIGINT), sum((importance >= 5)::BIGINT)]::BIGINT[]) AS passed FROM mem"""),
)
_add("tag_browse", lambda spark, sf_dir: g.browsed(memories(spark, sf_dir), ("en", "src1")).select("id", "memory_type"), _mem("SELECT id, memory_type FROM mem WHERE list_has_all(tags, ['en', 'src1'])"))
_add("point_lookup", lambda spark, sf_dir: memories(spark, sf_dir).where("id = 17").select("id", "text", "importance"), _mem("SELECT id, text, importance FROM mem WHERE id = 17"))
_add("paged_list", lambda spark, sf_dir: memories(spark, sf_dir).where("memory_type = 'EPISODIC'").orderBy("id").offset(20).limit(10).select("id", "ts_ms"), _mem("SELECT id, ts_ms FROM mem WHERE memory_type = 'EPISODIC' ORDER BY id LIMIT 10 OFFSET 20"))


def working_ring(spark, sf_dir, capacity: int = 100):
    """The newest memories of the working tier in each session, as many as the ring holds."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    rows = memories(spark, sf_dir).where("memory_type = 'WORKING'").withColumn("place", F.row_number().over(newest))
    return rows.where((F.col("place") <= capacity) & (F.col("tag_mask").bitwiseAND(F.lit(1)) == 1)).select("session_id", "id", "place")


_add(
    "working_ring",
    working_ring,
    _mem("""SELECT session_id, id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS place FROM mem
      WHERE memory_type = 'WORKING') WHERE place <= 100 AND (tag_mask & 1) = 1"""),
)


def session_page(spark, sf_dir, offset: int = 1, limit: int = 3):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(order))
    return rows.where((F.col("seq") > offset) & (F.col("seq") <= offset + limit)).select("conv_id", "seq", "role", "turn")


def session_tail(spark, sf_dir, n: int = 2):
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    rows = read(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(order))
    return rows.where(F.col("back") <= n).select("conv_id", "back", "role", "turn")


_add("session_page", session_page, "SELECT conv_id, seq::INT AS seq, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations) WHERE seq > 1 AND seq <= 4")
_add("session_tail", session_tail, "SELECT conv_id, back::INT AS back, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations) WHERE back <= 2")


def suppression(spark, sf_dir):
    """Memories that no error event names."""
    named = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return g.suppressed(memories(spark, sf_dir), named).select("id", "memory_type")


_add("suppression", suppression, _mem("SELECT id, memory_type FROM mem WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')"))

_SCORED = "score"


def _scored(spark, sf_dir):
    return memories(spark, sf_dir).withColumn("score", F.col("importance") / F.lit(10.0))


_BUCKET_SQL = """CASE WHEN age < 3600000 THEN 0 WHEN age < 21600000 THEN 1 WHEN age < 86400000 THEN 2 WHEN age < 259200000 THEN 3 WHEN age < 604800000 THEN 4
  WHEN age < 2419200000 THEN 5 WHEN age < 7776000000 THEN 6 WHEN age < 15552000000 THEN 7 WHEN age < 31536000000 THEN 8 WHEN age < 63072000000 THEN 9
  WHEN age < 157680000000 THEN 10 ELSE 11 END"""
#: Decay of a bucket b, from the buckets' middles.
_DECAY_SQL = "(CASE WHEN {b} = 0 THEN 1::DOUBLE ELSE greatest(0.10::DOUBLE, pow(([0.5, 3.5, 15, 48, 120, 420, 1440, 3240, 6480, 13140, 30660, 61320]::DOUBLE[])[({b} + 1)::INT] / 0.5::DOUBLE, -0.15::DOUBLE)) END)"
BUCKET_SQL, DECAY_SQL = _BUCKET_SQL, _DECAY_SQL

_add(
    "governance_gate",
    lambda spark, sf_dir: g.released(_scored(spark, sf_dir), NOW_MS, False, 0.5).select("id", F.round("score", 6).alias("score")),
    f"""WITH {MEMORIES_SQL}, a AS (SELECT *, importance / 10 AS score, {NOW_MS} - ts_ms AS age FROM mem),
      b AS (SELECT *, {_BUCKET_SQL} >> least(agent_recalls, 5) AS b FROM a)
      SELECT id, round(score, 6) AS score FROM b WHERE NOT retracted AND NOT restricted AND NOT (unverified AND score < 0.5 AND {_DECAY_SQL.format(b='b')} < 0.5)""",
)
_add("conflict_fail_closed", lambda spark, sf_dir: g.conflicts(_scored(spark, sf_dir), "FAIL_CLOSED").select("id"), _mem("SELECT id FROM mem WHERE NOT contradicted"))
_add("conflict_multi_evidence", lambda spark, sf_dir: g.conflicts(_scored(spark, sf_dir), "MULTI_EVIDENCE").select("id", "contradicted"), _mem("SELECT id, contradicted FROM mem"))
_add(
    "conflict_highest_confidence",
    lambda spark, sf_dir: g.conflicts(_scored(spark, sf_dir), "HIGHEST_CONFIDENCE").select("id", "contradicted"),
    _mem("""SELECT id, contradicted FROM mem WHERE NOT contradicted
      UNION ALL SELECT id, contradicted FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY importance DESC, id) AS n FROM mem WHERE contradicted) WHERE n = 1"""),
)


def metadata_filtering(spark, sf_dir):
    """The filter language over a map of strings."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.map_from_arrays(F.array(F.lit("lang"), F.lit("source"), F.lit("n"), F.lit("odd")), F.array("lang", "source", F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 1, F.lit("yes")))).alias("metadata"))
    wanted = g.parse_filter("(lang in ['en', 'fr'] && n >= 500 && not source == 'src3') || (odd is null && missing != 'x' && n < 200)")
    return rows.where(g.metadata_filter(wanted)).select("doc_id")


_add("metadata_filter", metadata_filtering, "SELECT doc_id FROM documents WHERE (lang IN ('en', 'fr') AND n_chars >= 500 AND NOT source = 'src3') OR (doc_id % 2 <> 1 AND n_chars < 200)")


def query_directives(spark, sf_dir):
    """Query lines, parsed."""
    lines = ["mode:hybrid k:5 the words", "k:x mode:odd only text", "mode:vector", "plain", "K:3 MODE:KEYWORD a b", ""]
    return spark.createDataFrame([(i, q.text, q.mode, q.top_k) for i, q in enumerate(map(g.parse_query, lines))], "line int, text string, mode string, top_k int")


_add("query_directives", query_directives, "SELECT * FROM (VALUES (0, 'the words', 'HYBRID', 5), (1, 'only text', 'KEYWORD', 10), (2, '', 'VECTOR', 10), (3, 'plain', 'KEYWORD', 10), (4, 'a b', 'KEYWORD', 3), (5, '', 'KEYWORD', 10)) t(line, text, mode, top_k)")
_add("json_path", lambda spark, sf_dir: read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
_add(
    "why_not",
    lambda spark, sf_dir: __import__("lodestar.operators.recall", fromlist=["why_not"]).why_not(_scored(spark, sf_dir), g.Gates(min_importance=2.0), NOW_MS, read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id")), 20),
    _mem("""SELECT id, CASE WHEN tombstoned THEN 'TOMBSTONED' WHEN id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'SUPPRESSED'
      WHEN NOT contradicted AND importance >= 2 THEN CASE WHEN row_number() OVER (PARTITION BY NOT tombstoned AND NOT contradicted AND importance >= 2
        AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') ORDER BY importance DESC, id) <= 20 THEN 'FOUND' ELSE 'OUTRANKED' END ELSE 'FILTERED' END AS reason FROM mem"""),
)
