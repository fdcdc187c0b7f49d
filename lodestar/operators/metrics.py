"""Retrieval quality and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg, mrr, recall at k. ranked: query_id, id, rank; judged: query_id, id,
    grade. The ideal is cut to as many places as the ranking has, k at most."""
    rows = ranked.where(F.col("rank") <= k).join(judged, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1.0) / F.log2(F.col("rank") + 1.0)
    got = rows.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum((F.col("grade") > 0).cast("long")).alias("hits"), F.count("*").alias("places"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = judged.where("grade > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    best = ideal.join(got.select("query_id", "places"), "query_id").where(F.col("place") <= F.col("places")).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1.0) / F.log2(F.col("place") + 1.0)).alias("idcg"))
    relevant = judged.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))
    found = got.join(best, "query_id", "left").join(relevant, "query_id", "left")
    return found.select(
        "query_id",
        F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)), 6).alias("recall"),
    )


def paired_test(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean difference, Cohen's d, z and the two-sided p of the normal distribution
    (by the error function's rational approximation)."""
    gap = F.col(a) - F.col(b)
    found = rows.agg(F.count("*").alias("n"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("sd"))
    z = F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    # Abramowitz and Stegun 7.1.26. Fixed values.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return found.select("n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") / F.col("sd"), 6).alias("cohens_d"), F.round(z, 4).alias("z"), F.round(poly * F.exp(-x * x), 5).alias("p"))
