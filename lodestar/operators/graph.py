"""Graphs of memories and entities: co-activation, spreading, bridges, paths, chains.

Edges are tables (src, dst, weight) with both directions stored. Walks are bounded
numbers of joins; each join sums or takes maxima before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, parallel ones summed, loops left out."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(turned).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def co_activation(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """a, b, n: how often two tags stand together, a < b.

    Pairs are of the tags of one row, of which there are few.
    """
    own = rows.select(F.sort_array(F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.greatest(F.size("t"), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.select(F.explode(pairs).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))


def associated(pairs: DataFrame, n: int = 5) -> DataFrame:
    """tag, other, n, place: the tags most often together with a tag."""
    both = pairs.select(F.col("a").alias("tag"), F.col("b").alias("other"), "n").unionByName(pairs.select(F.col("b").alias("tag"), F.col("a").alias("other"), "n"))
    order = Window.partitionBy("tag").orderBy(F.desc("n"), "other")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def stdp(events: DataFrame, by: str, order: Sequence[str], tag: str, ts_ms: str, gain: float = 0.1, loss: float = 0.05, tau_ms: float = 30_000.0) -> DataFrame:
    """src, dst, weight: a tag before another gains, the way back loses, both fading with
    the gap; weights stay within 0..1.

    Sums of gains and losses, clamped at the end: the order of the updates doesn't
    matter, so each group is summed before its shuffle.
    """
    own = Window.partitionBy(by).orderBy(*order)
    steps = events.select(F.lag(tag).over(own).alias("src"), F.col(tag).alias("dst"), (F.col(ts_ms) - F.lag(ts_ms).over(own)).alias("gap"))
    steps = steps.where(F.col("src").isNotNull() & (F.col("src") != F.col("dst")))
    fade = F.exp(-F.col("gap") / F.lit(tau_ms))
    forward = steps.select("src", "dst", (gain * fade).alias("w"))
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-loss * fade).alias("w"))
    total = forward.unionByName(back).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return total.select("src", "dst", F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)).alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame, depth: int = 2, half: float = 0.5, least: float = 0.01) -> DataFrame:
    """Activation that spreads from seeds (seed, id, strength): on each edge times its
    weight, on each level halved, ended below the least. The largest of a node's
    activations counts, seeds themselves don't."""
    level = seeds.select("seed", F.col("id").alias("at"), F.col("strength").alias("a"))
    found = None
    for step in range(depth):
        reach = level.join(edges, F.col("at") == F.col("src")).select("seed", F.col("dst").alias("at"), (F.col("a") * F.col("weight") * (half if step else 1.0)).alias("a"))
        level = reach.where(F.col("a") > least).groupBy("seed", "at").agg(F.max("a").alias("a"))
        rows = level.withColumn("hops", F.lit(step + 1))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("seed", F.col("at").alias("id")).agg(F.max("a").alias("activation"), F.min("hops").alias("hops"))
    return best.join(seeds.select("seed", "id"), ["seed", "id"], "left_anti")


def hebbian_scores(spread_: DataFrame, seeds: DataFrame, similarity: DataFrame, factor: float = 0.3) -> DataFrame:
    """Candidates: own similarity plus the seed's score times the (capped) activation."""
    rows = spread_.join(seeds.select("seed", F.col("strength").alias("s")).distinct(), "seed").join(similarity, "id", "left")
    score = F.coalesce("similarity", F.lit(0.0)) + F.col("s") * F.least(F.col("activation") / 5.0, F.lit(1.0)) * factor
    return rows.groupBy("id").agg(F.max(score).alias("score"))


def decayed(edges: DataFrame, factor: float = 0.9, least: float = 0.1, protect: int = 224) -> DataFrame:
    """Weights fade; weak edges go, unless they are bridges, which keep the least."""
    rows = edges.withColumn("weight", F.col("weight") * factor)
    bridge = F.col("bridge") >= protect
    return rows.where((F.col("weight") >= least) | bridge).withColumn("weight", F.when(bridge, F.greatest("weight", F.lit(least))).otherwise(F.col("weight")))


def bridges(edges: DataFrame) -> DataFrame:
    """src, dst, shared, bridge (0..255): how little two neighbours share, src < dst.

    Shared neighbours are counted by joining edges with wedges' closing edges; a wedge
    hangs on its end with fewer edges, so a hub makes no square of its degree.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    ranked = edges.join(degree.select(F.col("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    low = F.struct(F.col("ds"), F.col("src")) < F.struct(F.col("dd"), F.col("dst"))
    out = ranked.where(low).select("src", "dst")
    wedge = out.select(F.col("src").alias("m"), F.col("dst").alias("x")).join(out.select(F.col("src").alias("m"), F.col("dst").alias("y")), "m").where("x < y")
    closed = wedge.join(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    sides = closed.select(F.explode(F.array(F.struct(F.least("m", "x").alias("src"), F.greatest("m", "x").alias("dst")), F.struct(F.least("m", "y").alias("src"), F.greatest("m", "y").alias("dst")), F.struct(F.col("x").alias("src"), F.col("y").alias("dst")))).alias("e"))
    shared = sides.select(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("shared"))
    rows = ranked.where("src < dst").select("src", "dst", "weight", "ds", "dd").join(shared, ["src", "dst"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    part = F.floor((1.0 - F.col("shared") / F.greatest(F.least("ds", "dd"), F.lit(1))) * 255.0 + 0.5)
    score = F.when((F.col("ds") <= 1) & (F.col("dd") <= 1), F.lit(255)).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(255)).cast("int"))
    return rows.select("src", "dst", "weight", "shared", score.cast("int").alias("bridge"))


def min_labels(edges: DataFrame, checkpoint: Callable[[DataFrame, int | None], DataFrame], rows: int | None = None) -> DataFrame:
    """node, label: connected components by smallest labels with pointer jumping.

    Each round every node takes the smallest label among its neighbours' and its own, and
    then its label's label (which halves the length of chains). Labels only fall, so the
    rounds end when none falls; each is checkpointed. ``rows`` bounds the edges, both ways,
    where it is known. No edges have no components.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    both = checkpoint(both.where("node <> other").distinct(), rows)
    rows = both.count()  # there are no more nodes than rows
    found = checkpoint(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), rows)
    while True:
        seen = both.join(found.select(F.col("node").alias("other"), F.col("label").alias("o")), "other").groupBy("node").agg(F.min("o").alias("o"))
        near = found.join(seen, "node").select("node", F.least("label", "o").alias("label"), F.col("label").alias("was"))
        jump = found.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = checkpoint(near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), rows)
        if not now.where("label < was").take(1):
            return now.select("node", "label")
        found = now.select("node", "label")


def neighborhood(edges: DataFrame, start: DataFrame, hops: int = 2, most: int = 50) -> DataFrame:
    """node, hops: what is reached from the start nodes, the nearest first, so many at most."""
    found = start.select(F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0))
    front = found
    for step in range(1, hops + 1):
        reach = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = reach.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(step))
        found = found.unionByName(front)
    return found.orderBy("hops", "node").limit(most)


def overview(edges: DataFrame, most: int = 500) -> DataFrame:
    """The heaviest edges, each once."""
    return edges.where("src < dst").orderBy(F.desc("weight"), "src", "dst").limit(most).select("src", "dst", "weight")


def topology(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, largest degree, total weight."""
    degree = edges.groupBy("src").agg(F.count("*").alias("d"), F.sum("weight").alias("w"))
    return degree.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.round(F.avg("d"), 6).alias("mean_degree"), F.max("d").alias("largest_degree"), F.round(F.sum("w") / 2, 6).alias("weight"))


def chain(rows: DataFrame, by: str, order: Sequence[str], key: str = "id") -> DataFrame:
    """Each row with the rows before and after it in its session."""
    own = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("previous", F.lag(key).over(own)).withColumn("next", F.lead(key).over(own))


def chain_candidates(rows: DataFrame, seeds: DataFrame, by: str, order: Sequence[str], hops: int = 3, forward: float = 0.8, backward: float = 0.7, factor: float = 0.2) -> DataFrame:
    """id, score: up to so many steps along the chain from a seed (id, strength), each
    direction with its own weight."""
    own = Window.partitionBy(by).orderBy(*order)
    seeded = rows.join(seeds.select("id", "strength"), "id", "left")
    reach = [F.lag("strength", k).over(own) * forward * factor for k in range(1, hops + 1)]
    reach += [F.lead("strength", k).over(own) * backward * factor for k in range(1, hops + 1)]
    rows = seeded.select("id", *[c.alias(f"_{k}") for k, c in enumerate(reach)])
    return rows.select("id", F.greatest(*[F.col(f"_{k}") for k in range(len(reach))]).alias("score")).where("score IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))


def chain_pruned(rows: DataFrame, by: str, order: Sequence[str], dead: str) -> DataFrame:
    """The chain without dead rows: their neighbours become linked."""
    return chain(rows.where(~F.col(dead)), by, order)


# ---- hyperedges --------------------------------------------------------------------


def hyperedge_vertices(edges: DataFrame) -> DataFrame:
    """edge_id, kind, weight, memory, vertices array<struct<entity, role>> -> a row a vertex."""
    return edges.select("edge_id", "kind", "weight", "memory", F.explode("vertices").alias("v")).select("edge_id", "kind", "weight", "memory", "v.entity", "v.role")


def hyperedges_added(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The hyperedges with new ones (kind, weight, memory, vertices); an edge without a
    vertex is rejected, one of equal kind, memory and vertices is there already. Ids follow
    from the content, so a write that is tried again adds nothing."""
    key = lambda df: F.xxhash64(df["kind"], df["memory"], F.array_sort(df["vertices"]))
    rows = new.where(F.size("vertices") > 0)
    rows = rows.withColumn("_key", key(rows)).dropDuplicates(["_key"])
    fresh = rows.join(edges.select(key(edges).alias("_key")), "_key", "left_anti")
    return edges.unionByName(fresh.withColumn("edge_id", F.col("_key")).select(*edges.columns))


def hyperedges_boosted(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The hyperedges, those of two vertices heavier by what each pair (a, b, boost) of
    their entities adds, whichever comes first."""
    two = F.size("vertices") == 2
    names = F.array_sort(F.transform("vertices", lambda v: v["entity"]))
    wanted = pairs.groupBy(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.sum("boost").alias("_boost"))
    rows = edges.withColumn("_a", F.when(two, F.get(names, F.lit(0)))).withColumn("_b", F.when(two, F.get(names, F.lit(1))))
    return rows.join(wanted, ["_a", "_b"], "left").withColumn("weight", F.col("weight") + F.coalesce("_boost", F.lit(0.0))).select(*edges.columns)


def co_occurring(vertices: DataFrame) -> DataFrame:
    """a, b, n: entities of one hyperedge, a < b. Hyperedges are short."""
    own = vertices.groupBy("edge_id").agg(F.array_sort(F.collect_set("entity")).alias("tags"))
    return co_activation(own)


def collected(vertices: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """start, memory: the memories of the hyperedges within so many hops of an entity."""
    slim = vertices.select("edge_id", "entity", "memory")
    front = start.select(F.col("entity").alias("start"), "entity")
    found = None
    for _ in range(hops):
        edges = front.join(slim, "entity").select("start", "edge_id", "memory").distinct()
        found = edges if found is None else found.unionByName(edges)
        front = edges.select("start", "edge_id").join(slim.select("edge_id", "entity"), "edge_id").select("start", "entity").distinct()
    return found.select("start", "memory").distinct()


def entity_scores(refs: DataFrame, seeds: DataFrame, top: float, factor: float = 0.25) -> DataFrame:
    """id, score: memories of the seeds' entities; an entity of many memories says less."""
    fan = refs.groupBy("entity").agg((1.0 / F.sqrt(F.count("*"))).alias("fan"))
    asked = refs.join(seeds.select("id"), "id", "left_semi").select("entity").distinct()
    return refs.join(asked, "entity", "left_semi").join(fan, "entity").groupBy("id").agg(F.max(top * factor * F.col("fan")).alias("score"))


def similar_names(names: DataFrame, most: int = 2) -> DataFrame:
    """keep, drop: entity names of one type within so many edits; the shorter stays.

    Pairs share a deletion key: two names within k edits have an equal string after up
    to k deletions each (names are short). So only such names meet, not all of a type.
    """
    rows = names.select(F.lower("name").alias("name"), "type").distinct()
    keys = F.array(F.col("name"))
    for _ in range(most):
        shorter = F.flatten(F.transform(keys, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))), lambda i: F.concat(F.left(k, i - 1), F.substr(k, i + 1)))))
        keys = F.array_distinct(F.concat(keys, shorter))
    each = rows.select("name", "type", F.explode(keys).alias("k"))
    pairs = each.join(each.select(F.col("name").alias("other"), "type", "k"), ["type", "k"]).where(F.struct(F.length("name"), F.col("name")) < F.struct(F.length("other"), F.col("other"))).select("type", "name", "other").distinct()
    near = pairs.where(F.levenshtein("name", "other").between(1, most))
    return near.select("type", F.col("name").alias("keep"), F.col("other").alias("drop"))


# ---- paths -------------------------------------------------------------------------


def paths(edges: DataFrame, start: DataFrame, goal: DataFrame | None = None, hops: int = 3, most: int = 100) -> DataFrame:
    """Simple paths from the start nodes along src -relation-> dst, edges also walked
    backwards (as INVERSE_...), the shortest first, so many at most."""
    turned = edges.select(F.col("dst").alias("src"), F.concat(F.lit("INVERSE_"), "relation").alias("relation"), F.col("src").alias("dst"))
    ways = edges.select("src", "relation", "dst").unionByName(turned).distinct()
    front = start.select(F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    found = None
    for _ in range(hops):
        front = front.join(ways, F.col("at") == F.col("src")).where(~F.array_contains("nodes", F.col("dst"))).select(F.col("dst").alias("at"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("relations", F.col("relation")).alias("relations"))
        found = front if found is None else found.unionByName(front)
    if goal is not None:
        found = found.join(goal.select(F.col("id").alias("at")), "at", "left_semi")
    return found.select(F.size("relations").alias("length"), "nodes", "relations").orderBy("length", "nodes", "relations").limit(most)


def causal_chain(edges: DataFrame, start: DataFrame, hops: int = 5, backwards: bool = True) -> DataFrame:
    """start, step, node, confidence: the heaviest edge again and again, never to a node
    seen; confidence is the product of the clamped weights."""
    src, dst = ("dst", "src") if backwards else ("src", "dst")
    best = edges.select(F.col(src).alias("at"), F.col(dst).alias("to"), F.least(F.greatest("weight", F.lit(0.1)), F.lit(1.0)).alias("w"), F.col("weight").alias("raw"))
    front = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("seen"), F.lit(1.0).alias("confidence"))
    found = None
    for step in range(1, hops + 1):
        reach = front.join(best, "at").where(~F.array_contains("seen", F.col("to")))
        choice = reach.groupBy("start", "seen", "confidence").agg(F.max(F.struct("raw", (-F.col("to")).alias("n"), "w")).alias("m"))
        front = choice.select("start", (-F.col("m.n")).alias("at"), F.array_append("seen", -F.col("m.n")).alias("seen"), (F.col("confidence") * F.col("m.w")).alias("confidence"))
        rows = front.select("start", F.lit(step).alias("step"), F.col("at").alias("node"), F.round("confidence", 6).alias("confidence"))
        found = rows if found is None else found.unionByName(rows)
    return found
