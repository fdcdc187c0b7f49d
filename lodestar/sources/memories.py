"""The cognitive tables, derived from the tables of a data folder.

The data folders hold documents, vectors, events and conversations but no memories,
facts or graphs. These functions derive them by fixed rules; ``MEMORIES_SQL`` and its
companions state the same rules for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01T00:00:00Z: every query's fixed present.
NOW_MS = 1_706_745_600_000
TYPES = ("WORKING", "EPISODIC", "SEMANTIC", "PROCEDURAL")
PROVENANCES = ("OBSERVED", "USER_STATED", "REFLECTED", "INFERRED", "PROCEDURAL", "TRANSFERRED")
LANGUAGES = ("en", "fr", "de", "es")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str = "ts"):
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def _choice(index, names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory for each document."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    language = F.lit(0)
    for k, name in enumerate(LANGUAGES):
        language = F.when(F.col("lang") == name, F.lit(1 << k)).otherwise(language)
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int")
    return d.select(
        i.alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        _choice(i % 4, TYPES).alias("memory_type"),
        _choice(i % 6, PROVENANCES).alias("provenance"),
        F.array("lang", "source").alias("tags"),
        (language.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), 4 + F.coalesce(number, F.lit(0)) % 40)).alias("tag_mask"),
        (F.lit(NOW_MS) - i * 3_600_000).alias("ts_ms"),
        (F.lit(0.05) + (F.col("n_chars") % 1000) / F.lit(1000.0) * F.lit(9.95)).alias("importance"),
        ((i * 37) % 256 - 128).cast("int").alias("valence"),
        ((i * 53) % 256).cast("int").alias("arousal"),
        (i % 7).cast("int").alias("agent_recalls"),
        (i % 11).cast("int").alias("auto_recalls"),
        (F.lit(1.0) + (i % 9) * F.lit(0.5)).alias("strength"),
        (i % 19 == 0).alias("tombstoned"),
        (i % 23 == 0).alias("pinned"),
        (i % 3 != 0).alias("resolved"),
        (i % 17 == 0).alias("contradicted"),
        (i % 29 == 0).alias("retracted"),
        (i % 13 == 0).alias("unverified"),
        (i % 31 == 0).alias("restricted"),
        F.floor(i / 20).cast("long").alias("session_id"),
    )


MEMORIES_SQL = """
mem AS (
  SELECT doc_id AS id, coalesce(text, '') AS text,
    ['WORKING', 'EPISODIC', 'SEMANTIC', 'PROCEDURAL'][(doc_id % 4 + 1)::INT] AS memory_type,
    ['OBSERVED', 'USER_STATED', 'REFLECTED', 'INFERRED', 'PROCEDURAL', 'TRANSFERRED'][(doc_id % 6 + 1)::INT] AS provenance,
    [lang, source] AS tags,
    (CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 4 WHEN 'es' THEN 8 ELSE 0 END
      + (1::BIGINT << (4 + coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT), 0) % 40)))::BIGINT AS tag_mask,
    1706745600000 - doc_id * 3600000 AS ts_ms,
    0.05::DOUBLE + (n_chars % 1000) / 1000::DOUBLE * 9.95::DOUBLE AS importance,
    ((doc_id * 37) % 256 - 128)::INT AS valence, ((doc_id * 53) % 256)::INT AS arousal,
    (doc_id % 7)::INT AS agent_recalls, (doc_id % 11)::INT AS auto_recalls,
    1::DOUBLE + (doc_id % 9) * 0.5::DOUBLE AS strength,
    doc_id % 19 = 0 AS tombstoned, doc_id % 23 = 0 AS pinned, doc_id % 3 <> 0 AS resolved,
    doc_id % 17 = 0 AS contradicted, doc_id % 29 = 0 AS retracted, doc_id % 13 = 0 AS unverified,
    doc_id % 31 = 0 AS restricted, (doc_id // 20)::BIGINT AS session_id
  FROM documents)
"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories with a vector each: that of the id modulo the number of vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    n = vectors.count()
    own = vectors.select(F.col("vec_id").alias("v_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return memories(spark, sf_dir).join(own, F.col("id") % F.lit(max(n, 1)) == F.col("v_id")).drop("v_id")


EMBEDDED_SQL = (
    MEMORIES_SQL
    + """,
emb AS (SELECT mem.*, e.embedding::DOUBLE[] AS vector, e.label FROM mem JOIN embeddings e ON mem.id % (SELECT count(*) FROM embeddings) = e.vec_id)
"""
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts: users do events, until they do the same again."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").cast("long").alias("object"), epoch_ms().alias("valid_from"), "event_id")
    order = Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id")
    return rows.select(
        "fact_id", "subject", "predicate", "object", "valid_from",
        F.coalesce(F.lead("valid_from").over(order), F.lit((1 << 63) - 1)).alias("valid_to"),
        (F.col("valid_from") + (F.col("event_id") % 5) * 86_400_000).alias("tx_time"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("event_id") % 37 == 0, F.lag("fact_id").over(order)).alias("retracts"),
        (F.col("event_id") % 8 == 0).alias("inferred"),
    )


FACTS_SQL = """
fact AS (
  SELECT event_id AS fact_id, user_id AS subject, event_type AS predicate, (props ->> '$.k')::BIGINT AS object,
    (epoch_us(ts) // 1000) AS valid_from,
    coalesce(lead((epoch_us(ts) // 1000)) OVER w, 9223372036854775807) AS valid_to,
    (epoch_us(ts) // 1000) + (event_id % 5) * 86400000 AS tx_time, (event_id % 100) / 100::DOUBLE AS confidence,
    CASE WHEN event_id % 37 = 0 THEN lag(event_id) OVER w END AS retracts, event_id % 8 = 0 AS inferred
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY (epoch_us(ts) // 1000), event_id))
"""


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes: sequence, kind, memory_id, ts_ms, payload."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "REMEMBER").when(F.col("event_type") == "error", "FORGET").otherwise("REINFORCE")
    return e.select(F.col("event_id").alias("sequence"), kind.alias("kind"), F.col("user_id").alias("memory_id"), epoch_ms().alias("ts_ms"), F.col("value").alias("payload"))


WAL_SQL = """
wal AS (SELECT event_id AS sequence, CASE event_type WHEN 'purchase' THEN 'REMEMBER' WHEN 'error' THEN 'FORGET' ELSE 'REINFORCE' END AS kind,
  user_id AS memory_id, (epoch_us(ts) // 1000) AS ts_ms, value AS payload FROM events)
"""
