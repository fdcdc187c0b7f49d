"""Decisions about work: queues, subscriptions, buffers, triggers, limits, validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as v


def admitted(tasks: DataFrame, capacity: int, policy: str = "REJECT_FAST") -> DataFrame:
    """queue, sequence, priority -> the admitted tasks with their place of processing.

    A burst meets a queue of a capacity: REJECT_FAST keeps the first, DROP_OLDEST the
    last, CALLER_RUNS all (what doesn't fit runs at once, place 0). Work goes by
    priority, then by order. Only the best ``capacity`` rows of a queue survive the
    partial ranking before the shuffle.
    """
    if policy not in ("REJECT_FAST", "DROP_OLDEST", "CALLER_RUNS"):
        raise ValueError(f"unknown policy {policy}")
    arrival = F.desc("sequence") if policy == "DROP_OLDEST" else F.asc("sequence")
    rows = tasks.withColumn("arrival", F.row_number().over(Window.partitionBy("queue").orderBy(arrival)))
    if policy == "CALLER_RUNS":
        held = F.col("arrival") <= capacity
        work = Window.partitionBy("queue", held).orderBy(F.desc("priority"), "sequence")
        return rows.withColumn("place", F.when(held, F.row_number().over(work)).otherwise(F.lit(0))).drop("arrival")
    rows = rows.where(F.col("arrival") <= capacity)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "sequence"))).drop("arrival")


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events by subscription: of the subscribed type ("*" is any) and scope (null is any).

    events: event_id, type, scope; subscriptions: subscriber, type, scope (few: they are
    broadcast as a table that Spark finds small).
    """
    wanted = subscriptions.select("subscriber", F.col("type").alias("_key"), F.col("scope").alias("_scope"))
    # An event goes by its type and as any type, so both meet by an equal key.
    each = events.withColumn("_key", F.explode(F.array(F.col("type"), F.lit("*"))))
    rows = each.join(wanted, "_key").where(F.col("_scope").isNull() | (F.col("_scope") == F.col("scope")))
    return rows.select("subscriber", "event_id", "type").distinct()


def buffered(writes: DataFrame, now_ms: int, most: int = 64, ttl_ms: int = 5_000) -> DataFrame:
    """Of each session the newest writes that aren't older than the time to live."""
    order = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    fresh = writes.where((F.lit(now_ms) - F.col("ts_ms") <= ttl_ms) & (F.col("ts_ms") <= now_ms))
    return fresh.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def with_buffer(found: DataFrame, buffer: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A recall's results (query_id, id, score) with the buffered writes of the query's
    session, scored by cosine; what is in both counts once, with its larger score.

    queries: query_id, session_id, vector. A buffer is bounded by its size for each session.
    """
    own = buffer.select("session_id", "id", F.col("vector").alias("b")).join(queries.select("query_id", "session_id", F.col("vector").alias("q")), "session_id")
    scored = own.select("query_id", "id", F.round(v.cosine(F.col("b"), F.col("q")), 6).alias("score"))
    rows = found.select("query_id", "id", "score").unionByName(scored).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Circadian:
    """When a consolidation is due, and its limits. Fixed values."""

    volume: int = 100
    period_ms: int = 3_600_000
    tombstones: float = 0.30
    prune: float = 0.05
    interference: float = 0.12
    interference_factor: float = 0.7


def consolidation_due(rows: DataFrame, last_ms: int, now_ms: int, policy: Circadian = Circadian()) -> DataFrame:
    """memory_type, changes, tombstone_ratio, by_volume, by_time, compact: what is due.

    Volume counts the memories since the last run; one aggregation, no window.
    """
    found = rows.groupBy("memory_type").agg(F.sum((F.col("ts_ms") > last_ms).cast("long")).alias("changes"), F.avg(F.col("tombstoned").cast("double")).alias("ratio"))
    by_time = F.lit(now_ms - last_ms >= policy.period_ms)
    return found.select("memory_type", "changes", F.round("ratio", 6).alias("tombstone_ratio"), (F.col("changes") >= policy.volume).alias("by_volume"), (by_time & (F.col("changes") > 0)).alias("by_time"), (F.col("ratio") >= policy.tombstones).alias("compact"))


def rate_limited(requests: DataFrame, key: str, window_ms: int, most: int) -> DataFrame:
    """Requests with whether they are allowed: so many of a key in each window of time."""
    order = Window.partitionBy(key, F.floor(F.col("ts_ms") / window_ms)).orderBy("ts_ms", "id")
    return requests.withColumn("allowed", F.row_number().over(order) <= most)


def prefilter_chosen(counts: DataFrame, mode: str = "AUTO", selectivity: float = 0.30) -> DataFrame:
    """candidates, total -> prefilter: search only the filtered rows, or filter afterwards.

    AUTO filters first if the filter leaves at most the selectivity of the rows.
    """
    if mode not in ("AUTO", "ALWAYS", "NEVER"):
        raise ValueError(f"unknown mode {mode}")
    auto = (F.col("total") > 0) & (F.col("candidates") <= F.lit(selectivity) * F.col("total"))
    return counts.withColumn("prefilter", auto if mode == "AUTO" else F.lit(mode == "ALWAYS"))


def option_warnings(options: DataFrame) -> DataFrame:
    """The options with an array of what is odd about them; null options have defaults."""

    def of(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    rules = {
        "top_k must be positive": of("top_k", 10) <= 0,
        "mmr_lambda is outside 0..1": (of("mmr_lambda", 0.5) < 0) | (of("mmr_lambda", 0.5) > 1),
        "temperature must be positive": of("temperature", 1.0) <= 0,
        "min_valence exceeds max_valence": of("min_valence", -128) > of("max_valence", 127),
        "alpha and beta together exceed 1.5": of("alpha", 0.6) + of("beta", 0.4) > 1.5,
    }
    return options.withColumn("warnings", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def merged_texts(pairs: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs (a_text, b_text and headers a_*, b_*) merged: the text by the caller's function
    (without one the longer text, of equal ones the first), the headers by maxima and unions."""
    longer = F.when(F.length("b_text") > F.length("a_text"), F.col("b_text")).otherwise(F.col("a_text"))
    text = merge(F.col("a_text"), F.col("b_text")) if merge else longer
    return pairs.select(F.least("a", "b").alias("id"), text.alias("text"), F.greatest("a_importance", "b_importance").alias("importance"), F.col("a_tag_mask").bitwiseOR(F.col("b_tag_mask")).alias("tag_mask"), (F.col("a_recalls") + F.col("b_recalls")).alias("recalls"))


def traced(stages: Mapping[str, DataFrame]) -> DataFrame:
    """query_id, id, steps: what each stage (query_id, id, score) did to a result, in order.

    A step has the phase, the score and the number of candidates before and after; a
    result that a stage dropped ends with a null score. Stages hold a query's candidates,
    so a trace is one short array.
    """
    names = list(stages)
    rows, counts = None, None
    for k, (name, stage) in enumerate(stages.items()):
        own = stage.select("query_id", "id", F.lit(k).alias("k"), F.col("score").cast("double").alias("score"))
        number = stage.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(k).alias("k"), "n")
        rows, counts = (own, number) if rows is None else (rows.unionByName(own), counts.unionByName(number))
    held = counts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))
    scores = rows.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("k", "score"))).alias("scores"), F.max("k").alias("last")).join(held, "query_id")
    labels = F.array(*[F.lit(n) for n in names])

    def number(k: Column) -> Column:
        return F.when(k >= 0, F.coalesce(F.try_element_at("counts", k), F.lit(0))).otherwise(F.lit(0)).cast("long")

    def step(k: Column) -> Column:
        return F.struct(F.element_at(labels, k + 1).alias("phase"), F.when(k > 0, F.try_element_at("scores", k - 1)).alias("score_before"), F.try_element_at("scores", k).alias("score_after"), number(k - 1).alias("candidates_before"), number(k).alias("candidates_after"))

    steps = F.transform(F.sequence(F.lit(0), F.least(F.col("last") + 1, F.lit(len(names) - 1))), step)
    return scores.select("query_id", "id", steps.alias("steps"))
