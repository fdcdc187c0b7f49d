"""Scored recall over memories, and what comes after it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import scoring as s
from lodestar.operators.gates import Gates, gated
from lodestar.operators.vector_search import squared_distances

#: Queries and memories of a block.
BLOCK, QUERIES = 4096, 1024


@dataclass(frozen=True)
class Recall:
    """Options of a recall; the profile's weights and overrides are set by ``options``."""

    k: int = 10
    alpha: float = 0.6
    beta: float = 0.4
    strictness: float = 1.0
    tag_boost: float = 0.3
    query_mask: int = 0
    query_valence: int | None = None
    focus: float = 1.0
    lateral: bool = False
    lateral_distance: float = 1.2
    lateral_overlap: float = 0.5
    additive: bool = False
    gates: Gates = field(default_factory=Gates)


def options(profile: str, **changes) -> Recall:
    """A recall by profile name; unknown names are the balanced profile."""
    p = s.profile(profile)
    gates = Gates(memory_types=p.options.get("memory_types"), min_valence=None if p.min_valence == -128 else p.min_valence, max_valence=None if p.max_valence == 127 else p.max_valence, min_importance=p.options.get("min_importance"))
    base = Recall(alpha=p.alpha, beta=p.beta, gates=gates, lateral=p.options.get("lateral", False), strictness=p.options.get("strictness", 1.0), focus=p.options.get("focus", 1.0), query_valence=p.options.get("query_valence"))
    return Recall(**{**base.__dict__, **changes})


def with_decay(rows: DataFrame, now_ms: int, exponent: float = 0.15, floor: float = 0.10) -> DataFrame:
    """bucket, decay, boost of memories, after recalls, resolution and arousal."""
    now = F.lit(now_ms)
    bucket = s.reconsolidated(s.age_bucket(F.col("ts_ms"), now), F.col("agent_recalls"), F.col("auto_recalls"))
    rows = rows.withColumn("bucket", s.unresolved_bucket(bucket, F.col("resolved"), F.col("pinned")))
    rows = rows.withColumn("decay", s.aroused(s.bucket_decay(F.col("bucket"), exponent, floor), F.col("arousal")))
    return rows.withColumn("boost", s.storage_boost(F.col("strength")))


def recall(memories: DataFrame, queries: DataFrame, wanted: Recall, now_ms: int, digits: int = 6) -> DataFrame:
    """query_id, id, score, distance, rank (and branch with the lateral one).

    The gates run first, on plain columns; decay, boost and tag overlap are columns of a
    memory; then blocks of queries meet blocks of memories (id, vector, what the score
    needs), and only each block's best leave it. Texts are joined to the result.
    """
    rows = with_decay(gated(memories, wanted.gates, now_ms), now_ms)
    overlap = s.overlap(F.col("tag_mask"), F.lit(wanted.query_mask).cast("long"))
    valence = F.lit(1.0) if wanted.query_valence is None else 1.0 - F.abs(F.lit(wanted.query_valence) - F.col("valence")) / 255.0
    slim = rows.where(F.col("vector").isNotNull()).select("id", "vector", F.col("importance").alias("imp"), "decay", "boost", overlap.alias("share"), valence.alias("mood"))
    asked = queries.select("query_id", "vector")
    n_rows, n_queries = slim.count(), asked.count()
    query_blocks, row_blocks = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // BLOCK))
    left = slim.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).groupBy("rb").agg(F.collect_list(F.struct("id", "vector", "imp", "decay", "boost", "share", "mood")).alias("rows"))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).groupBy("qb").agg(F.collect_list(F.struct("query_id", "vector")).alias("queries"))
    side = max(1, wanted.k // 3)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for some, asks in zip(frame["rows"], frame["queries"], strict=True):
                ids = np.array([r["id"] for r in some])
                x = np.array([r["vector"] for r in some], float)
                q = np.array([a["vector"] for a in asks], float)
                imp, decay, boost, share, mood = (np.array([r[c] for r in some], float)[None, :] for c in ("imp", "decay", "boost", "share", "mood"))
                distance = np.sqrt(squared_distances(q, x))
                sim = 1 / (1 + distance * wanted.strictness)
                if wanted.additive:
                    main = wanted.alpha * sim + wanted.beta * imp * decay
                else:
                    main = sim * (1 + wanted.beta * (imp / 10) * decay * boost) * mood * (1 + share * wanted.tag_boost) * wanted.focus
                found = [("main", np.round(main, digits), np.ones_like(main, bool), wanted.k)]
                if wanted.lateral:
                    far = np.maximum(0, 1 - 0.25 * (distance**2 - 2) ** 2) * share * (1 + imp / 10 * decay)
                    found.append(("lateral", np.round(far, digits), (distance > wanted.lateral_distance) & (share >= wanted.lateral_overlap), side))
                for branch, score, valid, k in found:
                    score = np.where(valid, score, -np.inf)
                    best = min(k, len(ids))
                    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :best]
                    out = pd.DataFrame({"query_id": np.repeat([a["query_id"] for a in asks], best), "id": ids[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel(), "distance": np.take_along_axis(distance, order, axis=1).ravel(), "branch": branch})
                    yield out[np.isfinite(out["score"])]

    best = left.join(right, "qb").select("rows", "queries").mapInPandas(run, "query_id long, id long, score double, distance double, branch string")
    order = Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "id")
    limit = F.when(F.col("branch") == "main", F.lit(wanted.k)).otherwise(F.lit(side))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def why_not(scored: DataFrame, gates: Gates, now_ms: int, suppressions: DataFrame, k: int) -> DataFrame:
    """id, reason: why each memory isn't among the best k (FOUND if it is)."""
    passed = F.lit(True)
    for name, condition in gates.conditions(now_ms).items():
        if name != "tombstone":
            passed = passed & condition
    hidden = suppressions.select("id").distinct().withColumn("_hidden", F.lit(True))
    rows = scored.join(hidden, "id", "left").withColumn("_hidden", F.coalesce("_hidden", F.lit(False))).withColumn("_passed", passed)
    shown = rows.where(F.col("_passed") & ~F.col("tombstoned") & ~F.col("_hidden"))
    # The k best by a sort of partial results, no window over all rows.
    best = shown.orderBy(F.desc("score"), "id").limit(k).select("id", F.lit(True).alias("_best"))
    rows = rows.join(F.broadcast(best), "id", "left")  # k rows
    reason = F.when(F.col("tombstoned"), "TOMBSTONED").when(F.col("_hidden"), "SUPPRESSED").when(~F.col("_passed"), "FILTERED").when(F.col("_best"), "FOUND").otherwise("OUTRANKED")
    return rows.select("id", reason.alias("reason"))


def mmr(candidates: DataFrame, k: int = 10, balance: float = 0.5) -> DataFrame:
    """Greedy diversity: balance * score - (1 - balance) * the largest 1 / (1 + L2) to one
    taken. candidates: query_id, id, score, vector, GROUP for each query at most; adds place."""
    candidates = bounded_groups(candidates, "query_id", GROUP, "query")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x, score = np.stack(frame["vector"].to_list()), frame["score"].to_numpy()
        near = 1 / (1 + np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0)))
        left, taken = list(range(len(frame))), []
        worst = np.zeros(len(frame))
        while left and len(taken) < k:
            best = max(left, key=lambda i: (round(balance * score[i] - (1 - balance) * (worst[i] if taken else 0.0), 9), -i))
            taken.append(best)
            left.remove(best)
            worst = np.maximum(worst, near[best])
        return pd.DataFrame({"query_id": frame["query_id"].iloc[taken], "id": frame["id"].iloc[taken], "place": range(1, len(taken) + 1)})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, id long, place int")


def tempered(scored: DataFrame, t: float) -> DataFrame:
    """softmax(score / t) times the sum of the scores of a query; no change at t = 1 or
    for a single row."""
    if abs(t - 1.0) < 1e-4:
        return scored
    own = Window.partitionBy("query_id")
    weight = s.softmax_weight(F.col("score"), F.max("score").over(own), t)
    rows = scored.withColumn("_w", weight)
    value = F.col("_w") / F.sum("_w").over(own) * F.sum("score").over(own)
    return rows.withColumn("score", F.when(F.count("*").over(own) > 1, value).otherwise(F.col("score"))).drop("_w")


def habituated(scored: DataFrame, uses: DataFrame, now_ms: int, satiated_last: int = 10) -> DataFrame:
    """Scores times the habituation, inhibition of return and satiation of past recalls.

    uses: id, ts_ms of recalls. The newest ``satiated_last`` recalls are satiated.
    """
    seen = uses.groupBy("id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last"))
    newest = uses.orderBy(F.desc("ts_ms"), "id").limit(satiated_last).select("id", F.lit(True).alias("full")).distinct()
    rows = scored.join(seen, "id", "left").join(F.broadcast(newest), "id", "left")
    habit = F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(s.habituation(F.col("n")))
    penalty = s.combined_penalty(habit, s.inhibition_of_return(F.lit(now_ms), F.col("last")), F.coalesce("full", F.lit(False)))
    return rows.withColumn("penalty", penalty).withColumn("score", F.col("score") * F.col("penalty")).drop("n", "last", "full")


def running_surprise(events: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), warm_up: int = 20) -> DataFrame:
    """z of each value against all before it (population deviation; 0 while warming up),
    the importance that follows, and whether it is a flashbulb."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_n", F.count(value).over(past)).withColumn("_m", F.avg(value).over(past)).withColumn("_s", F.stddev_pop(value).over(past))
    z = F.when((F.col("_n") >= warm_up) & (F.col("_s") > 1e-12), (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    rows = rows.withColumn("z", z)
    bulb = s.flashbulb(F.col("z"), s.surprise_importance(F.col("z")))
    return rows.withColumn("importance", bulb["importance"]).withColumn("pinned", bulb["pinned"]).drop("_n", "_m", "_s")


def bandit(outcomes: DataFrame, by: str, order: Sequence[str], rate: float = 0.15, least: int = 10) -> DataFrame:
    """Exponential means of outcomes for each profile in each context, in order, and the
    best profile of contexts with enough signals.

    outcomes: context, profile, reward (0 or 1) and the order's columns. A context's
    signals of one profile are folded in the row of an aggregate.
    """
    folded = outcomes.groupBy(by, "profile").agg(F.sort_array(F.collect_list(F.struct(*order, "reward"))).alias("r"), F.count("*").alias("n"))
    value = F.aggregate("r", F.lit(0.5), lambda m, e: m * (1 - rate) + e["reward"] * rate)
    scored = folded.select(by, "profile", "n", value.alias("value"))
    best = Window.partitionBy(by).orderBy(F.desc("value"), "profile")
    total = F.sum("n").over(Window.partitionBy(by))
    rows = scored.withColumn("signals", total).withColumn("place", F.row_number().over(best))
    return rows.where("place = 1").select(by, F.when(F.col("signals") >= least, F.col("profile")).otherwise(F.lit("BALANCED")).alias("profile"), F.round("value", 6).alias("value"), "signals")


def introspected(results: DataFrame, now_ms: int) -> DataFrame:
    """What is known about each query's results: averages, confidence, staleness."""
    age = s.age_days(F.col("ts_ms"), F.lit(now_ms))
    rows = results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("importance").alias("importance"), F.avg("valence").alias("valence"), F.avg(age).alias("age_days"),
        F.avg("agent_recalls").alias("recalls"), F.avg((F.col("agent_recalls") > 0).cast("double")).alias("reinforced"),
    )
    confidence = F.least(F.lit(1.0), F.col("n") / 20.0) * 0.4 + F.col("reinforced") * 0.3 + F.least(F.lit(1.0), F.col("importance") / 5.0) * 0.3
    days = F.col("age_days")
    stale = F.when(days < 1, 0.0).when(days < 7, 0.2).when(days < 30, 0.5).when(days < 90, 0.7).otherwise(0.9)
    a_day = F.when(days > 0, F.col("recalls") / days).otherwise(F.col("recalls"))
    return rows.select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("importance", "valence", "age_days")], F.round(confidence, 6).alias("confidence"), stale.alias("staleness"), F.round(a_day, 6).alias("recalls_a_day"))


#: Shares of a context's budget, and characters of a token. Fixed values.
PACK_SHARES = {"WORKING": 0.20, "PROCEDURAL": 0.25, "SEMANTIC": 0.30, "EPISODIC": 0.25}
CHARS_PER_TOKEN = 4


def context_pack(results: DataFrame, tokens: int = 3000) -> DataFrame:
    """query_id, memory_type, id, place: the results that fit their tier's share of the
    budget, best first; one that doesn't fit is left out and later ones may still fit."""
    budget = F.lit(0)
    for tier, share in PACK_SHARES.items():
        budget = F.when(F.col("memory_type") == tier, F.lit(int(tokens * CHARS_PER_TOKEN * share))).otherwise(budget)
    rows = results.groupBy("query_id", "memory_type").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"), F.length("text").alias("n")))).alias("items"))
    start = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(held: Column, item: Column) -> Column:
        fits = held["used"] + item["n"] <= F.col("budget")
        return F.when(fits, F.struct((held["used"] + item["n"]).alias("used"), F.array_append(held["taken"], item["id"]).alias("taken"))).otherwise(held)

    packed = rows.withColumn("budget", budget).withColumn("p", F.aggregate("items", start, step))
    return packed.select("query_id", "memory_type", F.posexplode("p.taken").alias("place", "id"))


def gate_by_similarity(results: DataFrame, limit: float = 0.40) -> DataFrame:
    """Queries whose best similarity is below the limit: only these expand over graphs."""
    return results.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") < limit)


#: Queries that an associative memory takes at once: their states are small numbers of rows.
STATES = 10_000


def hopfield(patterns: DataFrame, queries: DataFrame, beta: float = 8.0, steps: int = 3) -> DataFrame:
    """query_id, state, energy: each step replaces a state by softmax(beta X q) X.

    A step is one pass over the patterns that sums, in blocks and then in tasks, what a
    softmax needs (largest value, weights, weighted vectors); the tasks' sums are merged
    by a shuffle. States are the stated queries only, STATES at most. The energy of the
    last state is |q|^2 / 2 - log(sum exp(beta X q)) / beta.
    """
    if queries.count() > STATES:
        raise ValueError(f"more than {STATES} queries: ask in blocks")
    states = [(r["query_id"], np.array(r["vector"], float)) for r in queries.select("query_id", "vector").orderBy("query_id").collect()]
    names = [n for n, _ in states]
    state = np.stack([x for _, x in states]) if states else np.zeros((0, 1))
    kind = "i int, top double, total double, v array<double>"

    def merged(a: tuple, b: tuple) -> tuple:
        top = np.maximum(a[0], b[0])
        x, y = np.exp(a[0] - top), np.exp(b[0] - top)
        return top, a[1] * x + b[1] * y, a[2] * x[:, None] + b[2] * y[:, None]

    def merge_rows(frame: pd.DataFrame) -> pd.DataFrame:
        top = frame["top"].max()
        scale = np.exp(frame["top"].to_numpy() - top)
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "top": [top], "total": [float(frame["total"].to_numpy() @ scale)], "v": [scale @ np.stack(frame["v"].to_list())]})

    def summed(now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["vector"].to_list())
                    z = beta * now @ x.T
                    top = z.max(axis=1)
                    w = np.exp(z - top[:, None])
                    own = (top, w.sum(axis=1), w @ x)
                    held = own if held is None else merged(held, own)
            if held is not None:
                yield pd.DataFrame({"i": np.arange(len(now)), "top": held[0], "total": held[1], "v": list(held[2])})

        rows = patterns.select("vector").mapInPandas(run, kind).groupBy("i").applyInPandas(merge_rows, kind).orderBy("i").collect()
        if not rows:
            return None
        return np.array([r["top"] for r in rows]), np.array([r["total"] for r in rows]), np.array([r["v"] for r in rows])

    energy = np.full(len(state), np.nan)
    for step in range(steps + 1):
        found = summed(state) if len(state) else None
        if found is None:
            break
        if step == steps:
            energy = (state**2).sum(axis=1) / 2 - (found[0] + np.log(found[1])) / beta
        else:
            state = found[2] / found[1][:, None]
    rows = [(n, [float(x) for x in row], float(e)) for n, row, e in zip(names, state, energy, strict=True)]
    return patterns.sparkSession.createDataFrame(rows, "query_id long, state array<double>, energy double")


#: Vectors of a group whose Gram matrix one task holds.
GROUP = 2_048


def bounded_groups(rows: DataFrame, key: str, most: int, what: str) -> DataFrame:
    """The rows, if no group has more than so many of them."""
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key).take(1)
    if large:
        raise ValueError(f"{what} {large[0][0]} has more than {most} rows")
    return rows


def integrated_information(groups: DataFrame, regularization: float = 1e-3) -> DataFrame:
    """group_id, vector -> phi: log-determinant of the diagonal minus that of the Gram
    matrix of a group's vectors. Groups are small by choice, GROUP vectors at most."""
    groups = bounded_groups(groups, "group_id", GROUP, "group")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("id")["vector"].to_list())
        gram = x @ x.T + regularization * np.eye(len(x))
        phi = 0.5 * (np.log(np.diag(gram)).sum() - np.linalg.slogdet(gram)[1])
        return pd.DataFrame({"group_id": [frame["group_id"].iloc[0]], "phi": [float(phi)], "n": [len(x)]})

    return groups.groupBy("group_id").applyInPandas(run, "group_id long, phi double, n int")


def predictive_boost(scored: DataFrame, tags: DataFrame, edges: DataFrame, factor: float = 0.3, context: int = 3) -> DataFrame:
    """Scores times 1 + w * factor, w the heaviest learnt edge from a tag of a query's
    first results to a tag of the row.

    scored: query_id, id, score, rank; tags: id, tags; edges: src, dst, weight.
    """
    tagged = scored.join(tags.select("id", "tags"), "id")
    before = tagged.where(F.col("rank") <= context).select("query_id", F.explode("tags").alias("src")).distinct()
    after = tagged.select("query_id", "id", F.explode("tags").alias("dst"))
    found = before.join(edges, "src").join(after, ["query_id", "dst"]).groupBy("query_id", "id").agg(F.max("weight").alias("w"))
    rows = scored.join(found, ["query_id", "id"], "left")
    return rows.withColumn("score", F.col("score") * (1.0 + F.coalesce("w", F.lit(0.0)) * factor)).drop("w")


def associative_mask(recent: DataFrame, pairs: DataFrame, bits: DataFrame, fade: float = 0.85, last: int = 20, each: int = 5, most: int = 10) -> DataFrame:
    """One row: the tags most associated with recently recalled ones, as a mask.

    recent: tag, age (recalls ago); pairs: tag, other, n, place; bits: tag, bit.
    """
    weight = recent.where(F.col("age") < last).groupBy("tag").agg(F.max(F.pow(F.lit(fade), F.col("age"))).alias("w"))
    best = weight.join(pairs.where(F.col("place") <= each), "tag").groupBy(F.col("other").alias("tag")).agg(F.max(F.col("w") * F.col("n")).alias("s"))
    chosen = best.orderBy(F.desc("s"), "tag").limit(most)
    return chosen.join(bits, "tag").agg(F.coalesce(F.expr("bit_or(bit)"), F.lit(0).cast("long")).alias("mask"), F.sort_array(F.collect_list("tag")).alias("tags"))


def importance_of(rows: DataFrame, novelty: Column, hints: tuple[Column, Column, Column] | None, topic: Column, self_: Column, agent: Column, z: Column) -> DataFrame:
    """importance, pinned: novelty or hints, times the boosts; a flashbulb overrides."""
    base = s.surprise_importance(novelty) if hints is None else s.icnu(hints[0], hints[1], novelty, hints[2])
    value = F.least(F.greatest(base * topic * self_ * agent, F.lit(0.05)), F.lit(10.0))
    bulb = s.flashbulb(z, value)
    return rows.withColumn("importance", bulb["importance"]).withColumn("pinned", bulb["pinned"])


def free_energy_rerank(scored: DataFrame, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> DataFrame:
    """alpha * similarity + beta * sigmoid(free-energy gain) + gamma * affective likeness.

    scored: similarity, gain and affect columns beside query_id, id.
    """
    value = alpha * F.col("similarity") + beta / (1.0 + F.exp(-F.col("gain"))) + gamma * F.col("affect")
    return scored.withColumn("score", value)


def workspace(scored: DataFrame, places: int = 7) -> DataFrame:
    """What of each query's results is held at once: the best few."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)


def replay_scores(rows: DataFrame) -> DataFrame:
    """Replayed rows have no similarity: every one counts half."""
    return rows.withColumn("score", F.lit(0.5))
