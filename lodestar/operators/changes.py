"""Change logs, replicas, compaction: event-sourced state of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replayed(log: DataFrame, until_ms: int | None = None, after: int | None = None, most: int | None = None) -> DataFrame:
    """The last change of each memory up to a time; forgotten ones are left out.

    log: sequence, kind, memory_id, ts_ms, payload. The last change is a maximum that is
    summed before its shuffle.
    """
    rows = log
    if after is not None:
        rows = rows.where(F.col("sequence") > after)
    if until_ms is not None:
        rows = rows.where(F.col("ts_ms") <= until_ms)
    if most is not None:
        rows = rows.orderBy("sequence").limit(most)
    last = rows.groupBy("memory_id").agg(F.max(F.struct("sequence", "kind", "ts_ms", "payload")).alias("m"), F.count("*").alias("changes"))
    return last.where("m.kind <> 'FORGET'").select("memory_id", F.col("m.sequence").alias("sequence"), F.col("m.kind").alias("kind"), F.col("m.ts_ms").alias("ts_ms"), F.col("m.payload").alias("payload"), "changes")


def truncated(log: DataFrame, before: int) -> DataFrame:
    """The log from a sequence on."""
    return log.where(F.col("sequence") >= before)


def remembered(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows to append: ids that aren't stored yet, each once (the first by its text)."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("m"))
    rows = first.select(key, *[F.col(f"m.{c}").alias(c) for c in new.columns if c != key])
    return rows.join(stored.select(key), key, "left_anti")


def forgotten(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows with the given ones marked."""
    marks = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marks, key, "left").withColumn("tombstoned", F.col("tombstoned") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def tombstone_ratios(rows: DataFrame, limit: float = 0.20) -> DataFrame:
    """memory_type, ratio, whether a compaction is due."""
    found = rows.groupBy("memory_type").agg(F.avg(F.col("tombstoned").cast("double")).alias("ratio"), F.count("*").alias("n"))
    return found.select("memory_type", F.round("ratio", 6).alias("ratio"), "n", (F.col("ratio") >= limit).alias("compact"))


def vacuumed(rows: DataFrame) -> DataFrame:
    """What a compaction keeps."""
    return rows.where(~F.col("tombstoned"))


def merged(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Two replicas of headers merged: the latest time and its valence, all tags, the
    largest importance and recalls, any tombstone, consolidation or pin."""
    a = local.select(key, *[F.col(c).alias(f"l_{c}") for c in local.columns if c != key])
    b = remote.select(key, *[F.col(c).alias(f"r_{c}") for c in remote.columns if c != key])
    both = a.join(b, key, "full")
    newer = F.col("l_ts_ms").isNull() | (F.col("r_ts_ms") >= F.col("l_ts_ms"))
    return both.select(
        key,
        F.greatest("l_ts_ms", "r_ts_ms").alias("ts_ms"),
        F.coalesce("l_tag_mask", F.lit(0).cast("long")).bitwiseOR(F.coalesce("r_tag_mask", F.lit(0).cast("long"))).alias("tag_mask"),
        F.greatest("l_importance", "r_importance").alias("importance"),
        F.greatest("l_agent_recalls", "r_agent_recalls").alias("agent_recalls"),
        F.when(newer & F.col("r_valence").isNotNull(), F.col("r_valence")).otherwise(F.col("l_valence")).alias("valence"),
        (F.coalesce("l_tombstoned", F.lit(False)) | F.coalesce("r_tombstoned", F.lit(False))).alias("tombstoned"),
        (F.coalesce("l_pinned", F.lit(False)) | F.coalesce("r_pinned", F.lit(False))).alias("pinned"),
    )


def would_change(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """id, change: would merging the remote header alter the local one?"""
    r = remote.select(key, *[F.col(c).alias(f"r_{c}") for c in remote.columns if c != key])
    rows = local.join(r, key)
    new_bits = F.col("r_tag_mask").bitwiseAND(F.bitwise_not("tag_mask")) != 0
    change = (F.col("r_ts_ms") > F.col("ts_ms")) | (F.col("r_importance") > F.col("importance")) | (F.col("r_agent_recalls") > F.col("agent_recalls")) | new_bits | (F.col("r_tombstoned") & ~F.col("tombstoned")) | (F.col("r_pinned") & ~F.col("pinned"))
    return rows.select(key, change.alias("change"))


def unchanged_skipped(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk"), text: str = "text") -> DataFrame:
    """New chunks that aren't stored with the same content."""
    old = stored.select(*keys, F.sha2(text, 256).alias("digest"))
    rows = new.withColumn("digest", F.sha2(text, 256))
    return rows.join(old, [*keys, "digest"], "left_anti")


def daily_maximum(events: DataFrame, ts: str, value: str) -> DataFrame:
    """The largest value and the number of rows of each day."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.max(value).alias("largest"), F.count("*").alias("n"))


def exported(rows: DataFrame) -> DataFrame:
    """id, json of the rows that aren't tombstoned."""
    kept = rows.where(~F.col("tombstoned"))
    return kept.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "tombstoned"])).alias("json"))
