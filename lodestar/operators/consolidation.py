"""Batch consolidation of memories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import scoring as s
from lodestar.operators.graph import min_labels
from lodestar.operators.recall import with_decay
from lodestar.operators.vector_search import assigned, near_links, near_older, near_pairs
from lodestar.sources.lineage import checkpointed


def pruned(rows: DataFrame, now_ms: int, least: float = 0.05) -> DataFrame:
    """Tombstones what decay has left too little of, unless pinned."""
    bucket = s.reconsolidated(s.age_bucket(F.col("ts_ms"), F.lit(now_ms)), F.col("agent_recalls"))
    weak = (F.col("importance") * s.bucket_decay(bucket) < least) & ~F.col("pinned")
    return rows.withColumn("tombstoned", F.col("tombstoned") | weak)


def sessions_joined(turns: DataFrame, by: str, order: tuple[str, ...], text: str, most: int = 500) -> DataFrame:
    """Each session's turns in order as one text. A consolidated session is a summary of
    ``most`` characters by definition: its turns and their text are cut to that."""
    rows = turns.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, F.left(F.coalesce(text, F.lit("")), F.lit(most)).alias("t")))).alias("r"), F.count("*").alias("turns"))
    return rows.select(by, "turns", F.left(F.concat_ws(" ", F.transform("r", lambda e: e["t"])), F.lit(most)).alias("text"))


def crystallized(turns: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Sessions of several turns as procedures."""
    return turns.groupBy(by).agg(F.count("*").alias("steps"), F.countDistinct("role").alias("roles")).where(F.col("steps") >= least)


def clustered(rows: DataFrame, centres: np.ndarray, least: int = 5) -> DataFrame:
    """For each cell of enough members: the most important one, all common tag bits."""
    cells = assigned(rows, centres)
    best = F.max(F.struct("importance", (-F.col("id")).alias("n")))
    found = cells.groupBy("cell").agg(F.count("*").alias("members"), best.alias("b"), F.expr("bit_and(tag_mask)").alias("tag_mask")).where(F.col("members") >= least)
    return found.select("cell", "members", (-F.col("b.n")).alias("id"), "tag_mask")


def _finite(vector: str) -> Column:
    """Whether a vector may be near another, or itself."""
    return F.forall(vector, lambda x: F.abs(x) < float("inf"))


def interfered(rows: DataFrame, radius: float, centres: np.ndarray, factor: float = 0.7) -> DataFrame:
    """Of near pairs the older loses importance, once however many pairs it is in.

    Rows of one vector are a class: all but its newest are older than that, and the newest
    is older if a near class has a newer one. Only classes are compared, not their rows.
    """
    key = F.xxhash64("vector")
    own = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(key.alias("_h"), "vector", "id", "ts_ms")
    classes = own.groupBy("_h", "vector").agg(F.min("id").alias("least"), F.max(F.struct("ts_ms", "id")).alias("last")).where(_finite("vector"))
    behind = near_older(classes.select(F.col("least").alias("id"), "vector", F.col("last.ts_ms").alias("t"), F.col("last.id").alias("n")), radius, centres)
    kept = classes.join(behind.select(F.col("id").alias("least"), F.lit(True).alias("_behind")), "least", "left")
    kept = kept.select("_h", "vector", F.coalesce("_behind", F.lit(False)).alias("_behind"), F.col("last.id").alias("_last"))
    found = rows.withColumn("_h", key).join(kept, ["_h", "vector"], "left")
    older = F.col("_behind") | (F.col("id") != F.col("_last"))
    return found.withColumn("importance", F.when(older, F.col("importance") * factor).otherwise(F.col("importance"))).select(*rows.columns)


def merged_duplicates(rows: DataFrame, radius: float, centres: np.ndarray) -> DataFrame:
    """kept, n, importance, tag_mask, ts_ms: of each group of near-duplicates (linked by
    pairs within the radius) the oldest id keeps the largest importance, all tags and
    the newest time. Groups are disjoint: no row is merged and keeps.

    Rows of one vector are summed up before any are compared, and links are looked for
    between such classes, as many as connect them."""
    sums = (F.max("importance").alias("importance"), F.expr("bit_or(tag_mask)").alias("tag_mask"), F.max("ts_ms").alias("ts_ms"))
    own = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(F.xxhash64("vector").alias("_h"), "vector", "id", "importance", "tag_mask", "ts_ms")
    classes = own.groupBy("_h", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n"), *sums).where(_finite("vector"))
    labels = min_labels(near_links(classes.select("id", "vector"), radius, centres), checkpointed)
    members = classes.drop("_h", "vector").join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    return members.groupBy(F.coalesce("label", "id").alias("kept")).agg(F.sum("n").alias("n"), *sums).where("n > 1")


def bulk_decayed(rows: DataFrame, now_ms: int, older_ms: int, factor: float) -> DataFrame:
    """What is older loses importance by the factor."""
    return rows.withColumn("importance", F.when(F.lit(now_ms) - F.col("ts_ms") > older_ms, F.col("importance") * factor).otherwise(F.col("importance")))


def retained(rows: DataFrame, now_ms: int, retention_ms: int, least: float = 1.0) -> DataFrame:
    """Without what is older than the retention or less important than the least."""
    return rows.where((F.lit(now_ms) - F.col("ts_ms") <= retention_ms) & (F.col("importance") >= least))


def contradiction_winner(pairs: DataFrame) -> DataFrame:
    """Of two contradicting records (a, b with their times and strengths): later, then
    stronger, then the smaller id."""
    first = F.struct(F.col("a_ts").alias("t"), F.col("a_strength").alias("s"), (-F.col("a")).alias("i"))
    second = F.struct(F.col("b_ts").alias("t"), F.col("b_strength").alias("s"), (-F.col("b")).alias("i"))
    wins = first >= second
    return pairs.select("a", "b", F.when(wins, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(wins, F.col("b")).otherwise(F.col("a")).alias("loser"))


def reminders_due(reminders: DataFrame, now_ms: int, score: float = 10.0) -> DataFrame:
    """Reminders whose time has come, as results of the highest score."""
    return reminders.where(F.col("trigger_ms") <= now_ms).withColumn("score", F.lit(score))


def refused(rows: DataFrame, version: int, batch: int) -> DataFrame:
    """Rows of an older version, the most surprising first, with their importance anew."""
    old = rows.where(F.col("version") < version).orderBy(F.desc("surprise"), "id").limit(batch)
    return old.withColumn("importance", s.surprise_importance(F.col("surprise"))).withColumn("version", F.lit(version))


def promoted(pairs: DataFrame, least: float = 3.0) -> DataFrame:
    """Co-activated pairs heavy enough to become hyperedges, with their weight's boost."""
    return pairs.where(F.col("weight") >= least).withColumn("boost", F.least(F.col("weight") * 0.05, F.lit(0.3)))


def eager(new: DataFrame, stored: DataFrame, radius: float, centres: np.ndarray) -> DataFrame:
    """The nearest stored record within the radius of each new one."""
    both = stored.select("id", "vector").unionByName(new.select("id", "vector"))
    pairs = near_pairs(both, radius, centres)
    sides = pairs.select(F.col("a").alias("new"), F.col("b").alias("old"), "distance").unionByName(pairs.select(F.col("b").alias("new"), F.col("a").alias("old"), "distance"))
    own = sides.join(new.select(F.col("id").alias("new")), "new", "left_semi").join(stored.select(F.col("id").alias("old")), "old", "left_semi")
    order = Window.partitionBy("new").orderBy("distance", "old")
    return own.withColumn("n", F.row_number().over(order)).where("n = 1").select("new", "old", "distance")


def reflected(rows: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Prune, fade, retain: one pass over the memories, no shuffle."""
    kept = pruned(with_decay(rows, now_ms), now_ms).where(~F.col("tombstoned"))
    return retained(bulk_decayed(kept, now_ms, retention_ms // 2, 0.9), now_ms, retention_ms, 0.5)
