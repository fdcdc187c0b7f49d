"""Bitemporal facts: validity, transaction time, retraction, conflict resolution.

facts: fact_id, subject, predicate, object, valid_from, valid_to (exclusive; the
largest long is open), tx_time, confidence, retracts, inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = (1 << 63) - 1


def unretracted(facts: DataFrame, as_of: int | None = None) -> DataFrame:
    """Facts that no other retracts (known by ``as_of``, if given)."""
    retractions = facts.where("retracts IS NOT NULL")
    if as_of is not None:
        retractions = retractions.where(F.col("tx_time") <= as_of)
    return facts.join(retractions.select(F.col("retracts").alias("fact_id")).distinct(), "fact_id", "left_anti")


def query(facts: DataFrame, valid_at: int | None = None, valid_during: tuple[int, int] | None = None, as_of: int | None = None, predicate: str | None = None, min_confidence: float | None = None, retracted: bool = False, inferred: bool = True, strict: bool = False) -> DataFrame:
    """The facts that hold; retractions count whenever they were made, or with
    ``strict`` only if they were known by ``as_of``."""
    rows = facts if retracted else unretracted(facts, as_of if strict else None)
    if as_of is not None:
        rows = rows.where(F.col("tx_time") <= as_of)
    if valid_at is not None:
        rows = rows.where((F.col("valid_from") <= valid_at) & (F.col("valid_to") > valid_at))
    if valid_during is not None:
        rows = rows.where((F.col("valid_from") < valid_during[1]) & (F.col("valid_to") > valid_during[0]))
    if predicate is not None:
        rows = rows.where(F.col("predicate") == predicate)
    if min_confidence is not None:
        rows = rows.where(F.col("confidence") >= min_confidence)
    return rows if inferred else rows.where(~F.col("inferred"))


_ORDERS = {
    "latest": ("tx_time", "fact_id"),
    "confidence": ("confidence", "fact_id"),
    "conflict": ("confidence", "tx_time", "fact_id"),
}


def winners(rows: DataFrame, resolver: str = "latest") -> DataFrame:
    """One fact for each subject and predicate, as a maximum that is summed before its
    shuffle: a subject with most of the facts makes no hot task."""
    keys = _ORDERS[resolver]
    others = [c for c in rows.columns if c not in ("subject", "predicate", *keys)]
    best = rows.groupBy("subject", "predicate").agg(F.max(F.struct(*keys, *others)).alias("m"))
    return best.select("subject", "predicate", *[F.col(f"m.{c}").alias(c) for c in (*keys, *others)])


def evidence(rows: DataFrame) -> DataFrame:
    """For each subject and predicate the best fact, the distance to the next, and what to do."""
    order = Window.partitionBy("subject", "predicate").orderBy(F.desc("confidence"), F.desc("tx_time"), F.desc("fact_id"))
    ranked = rows.withColumn("place", F.row_number().over(order)).where("place <= 2")
    pairs = ranked.groupBy("subject", "predicate").agg(F.max(F.when(F.col("place") == 1, F.struct("fact_id", "confidence", "valid_from"))).alias("w"), F.max(F.when(F.col("place") == 2, F.struct("fact_id", "confidence", "valid_from"))).alias("r"))
    delta = F.col("w.confidence") - F.col("r.confidence")
    entropy = F.when(F.col("r").isNull(), 0.0).otherwise(1.0 - F.least(F.greatest(delta, F.lit(0.0)), F.lit(1.0)))
    policy = (
        F.when(F.col("r").isNull(), F.when(F.col("w.confidence") < 0.30, "ABSTAIN").otherwise("ACCEPT_WINNER"))
        .when((F.col("w.confidence") < 0.30) & (F.col("r.confidence") < 0.30), "ABSTAIN")
        .when(delta < 0.15, "ASK_CLARIFYING_QUESTION")
        .when(F.col("w.valid_from") != F.col("r.valid_from"), "PRESENT_ALTERNATIVES")
        .otherwise("ACCEPT_WINNER")
    )
    return pairs.select("subject", "predicate", F.col("w.fact_id").alias("fact_id"), F.round(entropy, 6).alias("entropy"), policy.alias("policy"))


def asserted(facts: DataFrame, new: DataFrame, coexisting: tuple[str, ...] = ()) -> DataFrame:
    """Append facts; each closes the open fact of its subject and predicate (unless the
    predicate's facts may coexist), from its own beginning on."""
    starts = new.where(~F.col("predicate").isin(*coexisting)) if coexisting else new
    starts = starts.groupBy("subject", "predicate").agg(F.min("valid_from").alias("_from"))
    closed = facts.join(starts, ["subject", "predicate"], "left")
    ends = F.when((F.col("valid_to") == OPEN) & F.col("_from").isNotNull() & (F.col("_from") > F.col("valid_from")), F.col("_from")).otherwise(F.col("valid_to"))
    return closed.withColumn("valid_to", ends).drop("_from").unionByName(new)


def history(facts: DataFrame) -> DataFrame:
    """All versions of each subject and predicate in order, with what superseded them."""
    order = Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id")
    retracted = facts.where("retracts IS NOT NULL").select(F.col("retracts").alias("fact_id")).distinct().withColumn("retracted", F.lit(True))
    rows = facts.withColumn("version", F.row_number().over(order)).withColumn("superseded_by", F.lead("fact_id").over(order))
    return rows.join(retracted, "fact_id", "left").select("subject", "predicate", "version", "fact_id", "superseded_by", F.coalesce("retracted", F.lit(False)).alias("retracted"))


def woven(records: DataFrame, facts: DataFrame, key: str = "id", at: str = "ts_ms") -> DataFrame:
    """Records with the facts about them that held at their time: an interval join on an
    equal key."""
    rows = records.join(facts.select(F.col("subject").alias(key), "fact_id", "predicate", "object", "valid_from", "valid_to"), key)
    return rows.where((F.col("valid_from") <= F.col(at)) & (F.col(at) < F.col("valid_to")))
