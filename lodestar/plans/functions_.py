"""Scalar functions, ingestion, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import bits, dates, text as t
from lodestar.sources import files, sinks
from lodestar.sources.memories import MEMORIES_SQL, memories, read
from lodestar.streaming import streams

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


_add("normalize_whitespace", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.md5(t.single_spaced(F.coalesce("text", F.lit("")))).alias("digest")), "SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS digest FROM documents")
_add("truncate_text", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", t.truncated(F.col("text"), 50).alias("head")), "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS head FROM documents")
_add("token_estimate", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", t.estimated_tokens(F.col("text")).alias("tokens"), (t.estimated_tokens(F.col("text")) > 512).alias("over")), "SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS tokens, (length(text) + 3) // 4 > 512 AS over FROM documents")
_add(
    "parse_numbers",
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", t.parsed_long(F.regexp_replace("source", "src", ""), -1).alias("n"), t.parsed_long(F.col("source"), -1).alias("bad"), t.parsed_double(F.concat(F.col("n_chars").cast("string"), F.lit(".5 ")), 0.0).alias("x")),
    "SELECT doc_id, TRY_CAST(replace(source, 'src', '') AS BIGINT) AS n, -1::BIGINT AS bad, n_chars + 0.5::DOUBLE AS x FROM documents",
)
_add(
    "relative_dates",
    lambda spark, sf_dir: read(spark, sf_dir, "events").select("event_id", *[dates.resolved(F.lit(p), F.to_date("ts")).alias(p.replace(" ", "_")) for p in ("yesterday", "today", "tomorrow", "last monday", "next friday", "last week", "next month")]),
    """WITH e AS (SELECT event_id, ts::DATE AS d FROM events) SELECT event_id, d - 1 AS yesterday, d AS today, d + 1 AS tomorrow, (d - ((isodow(d) + 5) % 7 + 1)::INT)::DATE AS last_monday,
      (d + ((11 - isodow(d)) % 7 + 1)::INT)::DATE AS next_friday, d - 7 AS last_week, (d + INTERVAL 1 MONTH)::DATE AS next_month FROM e""",
)
_add(
    "temporal_phrases",
    lambda spark, sf_dir: dates.annotated(spark.createDataFrame([(1, "We met yesterday, and again next Friday or last month."), (2, "nothing")], "id long, text string"), "text", F.to_date(F.lit("2024-01-31"))),
    "SELECT * FROM (VALUES (1::BIGINT, 'yesterday', DATE '2024-01-30'), (1::BIGINT, 'next friday', DATE '2024-02-02'), (1::BIGINT, 'last month', DATE '2023-12-31')) t(id, phrase, day)",
)
_add(
    "calculator",
    lambda spark, sf_dir: spark.createDataFrame([(e, float(round(dates.calculated(e), 9))) for e in ("1 + 2 * 3", "(4 - 1) ^ 2 % 5", "sqrt(16) + abs(-3)", "15% of 80", "sin(0) + cos(0) + log(e)", "-2 ^ 2")], "expression string, value double"),
    "SELECT * FROM (VALUES ('1 + 2 * 3', 7::DOUBLE), ('(4 - 1) ^ 2 % 5', 4::DOUBLE), ('sqrt(16) + abs(-3)', 7::DOUBLE), ('15% of 80', 12::DOUBLE), ('sin(0) + cos(0) + log(e)', 2::DOUBLE), ('-2 ^ 2', -4::DOUBLE)) t(expression, value)",
)
_add("bloom_tags", lambda spark, sf_dir: memories(spark, sf_dir).select("id", bits.tag_filter(F.col("tags")).alias("filter")).select("id", F.bit_count("filter").alias("bits"), F.forall(F.array(F.lit(True)), lambda x: x).alias("ok")))
_add("tag_overlap", lambda spark, sf_dir: memories(spark, sf_dir).select("id", F.round(bits.overlap(F.col("tag_mask"), 99), 6).alias("share")), f"WITH {MEMORIES_SQL} SELECT id, round(bit_count(tag_mask & 99) / bit_count(99::BIGINT), 6) AS share FROM mem")
_add(
    "header_flags",
    lambda spark, sf_dir: memories(spark, sf_dir).select("id", bits.header_flags(F.col("tombstoned"), F.col("memory_type"), F.lit(False), F.col("pinned"), F.col("resolved")).alias("flags"), bits.quantized_weight(F.col("importance") / 10.0).alias("weight")),
    f"""WITH {MEMORIES_SQL} SELECT id, (tombstoned::INT | (CASE memory_type WHEN 'WORKING' THEN 0 WHEN 'EPISODIC' THEN 2 WHEN 'SEMANTIC' THEN 4 ELSE 6 END) | (pinned::INT << 4) | (resolved::INT << 5))::INT AS flags,
      floor(least(greatest(importance / 10, 0), 1) * 255 + 0.5::DOUBLE)::INT AS weight FROM mem""",
)
_add("metadata_merge", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.to_json(F.map_concat(F.create_map(F.lit("lang"), F.col("lang")), F.create_map(F.lit("src"), F.col("source")))).alias("json")), """SELECT doc_id, '{"lang":"' || lang || '","src":"' || source || '"}' AS json FROM documents""")
_add("tag_union", lambda spark, sf_dir: memories(spark, sf_dir).select("id", F.array_union("tags", F.array(F.lit("en"), F.lit("x"))).alias("tags")), f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN tags[1] = 'en' THEN ['en', tags[2], 'x'] ELSE [tags[1], tags[2], 'en', 'x'] END AS tags FROM mem")
_add(
    "encryption_round_trip",
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", "source", F.aes_encrypt("source", F.lit("0123456789abcdef0123456789abcdef"), F.lit("GCM")).alias("c")).select("doc_id", F.aes_decrypt("c", F.lit("0123456789abcdef0123456789abcdef"), F.lit("GCM")).cast("string").alias("source")),
    "SELECT doc_id, source FROM documents",
)
_add("content_hash", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")
_add("template_render", lambda spark, sf_dir: read(spark, sf_dir, "nation").select("n_nationkey", dates.rendered("{{n_name}} lies in region {{ n_regionkey }}.", ["n_name", "n_regionkey"]).alias("text")), "SELECT n_nationkey, n_name || ' lies in region ' || n_regionkey || '.' AS text FROM nation")
_add("sql_question", lambda spark, sf_dir: files.guarded_sql(spark, sf_dir, "SELECT n_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", allowed=("nation", "region")), "SELECT n_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
_add("file_discovery", lambda spark, sf_dir: files.discovered(spark, sf_dir, "*.parquet").groupBy("suffix").agg((F.count("*") > 0).alias("found")), "SELECT 'parquet' AS suffix, true AS found")
_add("ingestion_pipeline", lambda spark, sf_dir: sinks.ingested(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), files.hashed_embedder(16)).groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.size("vector")).alias("numbers")))
_add("connector_sink", lambda spark, sf_dir: sinks.connected(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), None).groupBy("id").agg(F.count("*").alias("chunks")))
_add(
    "bundle_round_trip",
    lambda spark, sf_dir: sinks.bundle_round_trip(memories(spark, sf_dir).select("id", "memory_type", "importance"), "memories"),
    f"WITH {MEMORIES_SQL} SELECT id, memory_type, importance FROM mem",
)
_add(
    "hdc_similarity",
    lambda spark, sf_dir: bits.hypervector_similarity(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")),
)

# ---- streams -------------------------------------------------------------------------

_add(
    "stream_tumbling",
    lambda spark, sf_dir: streams.drained(spark, streams.tumbling(streams.events(spark, sf_dir)), "complete"),
    "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
_add(
    "stream_sessions",
    lambda spark, sf_dir: streams.drained(spark, streams.sessions(streams.events(spark, sf_dir), "12 hours"), "complete"),
    """WITH g AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR AS cut FROM events),
      s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
_add(
    "stream_dedup",
    lambda spark, sf_dir: streams.drained(spark, streams.deduplicated(streams.events(spark, sf_dir), ["event_id"]), "append"),
    "SELECT event_id, user_id, event_type FROM events",
)
_add("stream_habituation", lambda spark, sf_dir: streams.drained(spark, streams.habituation(streams.events(spark, sf_dir)), "update", ("user_id",)), "SELECT user_id, count(*) AS n, round(1 / (1 + (count(*) - 1) * 0.2::DOUBLE), 6) AS penalty FROM events GROUP BY user_id")
_add(
    "stream_welford",
    lambda spark, sf_dir: streams.drained(spark, streams.welford(streams.events(spark, sf_dir)), "update", ("event_type",)).select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation")),
    "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(value) >= 20 THEN stddev_pop(value) ELSE 0 END, 4) AS deviation FROM events GROUP BY event_type",
)
_add("stream_upsert", lambda spark, sf_dir: streams.last_by_batches(spark, sf_dir), "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
_add("session_windows_batch", lambda spark, sf_dir: streams.sessions(read(spark, sf_dir, "events"), "5 minutes"), """WITH g AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 5 MINUTE AS cut FROM events),
      s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
