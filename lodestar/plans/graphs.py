"""Graph queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import graph as g
from lodestar.sources.lineage import checkpointed
from lodestar.sources.memories import MEMORIES_SQL, embedded, epoch_ms, memories, read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


def edges(spark, sf_dir):
    """Users whose events follow one another within a type: an undirected weighted graph."""
    from pyspark.sql import Window

    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select(F.lag("user_id").over(order).alias("src"), F.col("user_id").alias("dst"), F.lit(1.0).alias("weight"))
    return g.both_ways(e.where("src IS NOT NULL"))


EDGES = """st AS (SELECT lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s, user_id AS d FROM events),
  ed AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, d AS dst FROM st UNION ALL SELECT d, s FROM st) WHERE src <> dst GROUP BY ALL)"""
_add("hebbian_edges", edges, f"WITH {EDGES} SELECT src, dst, weight FROM ed")
_add("co_activation", lambda spark, sf_dir: g.co_activation(memories(spark, sf_dir)), f"WITH {MEMORIES_SQL} SELECT least(tags[1], tags[2]) AS a, greatest(tags[1], tags[2]) AS b, count(*) AS n FROM mem WHERE tags[1] <> tags[2] GROUP BY ALL")
_add(
    "associated_tags",
    lambda spark, sf_dir: g.associated(g.co_activation(memories(spark, sf_dir))),
    f"""WITH {MEMORIES_SQL}, p AS (SELECT least(tags[1], tags[2]) AS a, greatest(tags[1], tags[2]) AS b, count(*) AS n FROM mem WHERE tags[1] <> tags[2] GROUP BY ALL),
      u AS (SELECT a AS tag, b AS other, n FROM p UNION ALL SELECT b, a, n FROM p) SELECT tag, other, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS place FROM u) WHERE place <= 5""",
)
_add(
    "stdp_weights",
    lambda spark, sf_dir: g.stdp(read(spark, sf_dir, "events").withColumn("ms", epoch_ms()), "user_id", ("ts", "event_id"), "event_type", "ms", tau_ms=3.6e7).select("src", "dst", F.round("weight", 6).alias("weight")),
    """WITH l AS (SELECT lag(event_type) OVER w AS s, event_type AS d, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      f AS (SELECT * FROM l WHERE s <> d), u AS (SELECT s AS src, d AS dst, 0.1::DOUBLE * exp(-gap / 3.6e7) AS w FROM f UNION ALL SELECT d, s, -0.05::DOUBLE * exp(-gap / 3.6e7) FROM f)
      SELECT src, dst, round(least(greatest(sum(w), 0), 1), 6) AS weight FROM u GROUP BY ALL""",
)


def seeds(spark, sf_dir):
    """The stated seeds: users whose id is divisible by 20."""
    return read(spark, sf_dir, "events").where("user_id % 20 = 0").select(F.col("user_id").alias("id")).distinct().select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("strength"))


def _light(spark, sf_dir):
    return edges(spark, sf_dir).withColumn("weight", F.col("weight") / F.lit(20.0))


_SPREAD = f"""{EDGES}, s AS (SELECT DISTINCT user_id AS seed FROM events WHERE user_id % 20 = 0), w AS (SELECT src, dst, weight / 20 AS weight FROM ed),
  l1 AS (SELECT seed, dst AS id, max(weight) AS a FROM s JOIN w ON seed = src WHERE weight > 0.01 GROUP BY ALL),
  l2 AS (SELECT seed, dst AS id, max(a * weight * 0.5::DOUBLE) AS a FROM l1 JOIN w ON id = src WHERE a * weight * 0.5::DOUBLE > 0.01 GROUP BY ALL),
  b AS (SELECT seed, id, max(a) AS activation, min(h)::INT AS hops FROM (SELECT *, 1 AS h FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY seed, id)"""
_add(
    "hebbian_spreading",
    lambda spark, sf_dir: g.spread(seeds(spark, sf_dir), _light(spark, sf_dir)).select("seed", "id", F.round("activation", 6).alias("activation"), "hops"),
    f"WITH {_SPREAD} SELECT seed, id, round(activation, 6) AS activation, hops FROM b WHERE seed <> id",
)
_add(
    "hebbian_candidates",
    lambda spark, sf_dir: g.hebbian_scores(g.spread(seeds(spark, sf_dir), _light(spark, sf_dir)), seeds(spark, sf_dir), memories(spark, sf_dir).select("id", (F.col("importance") / 10.0).alias("similarity"))).select("id", F.round("score", 6).alias("score")),
    f"WITH {_SPREAD}, {MEMORIES_SQL} SELECT b.id, round(max(coalesce(importance / 10, 0) + least(activation / 5, 1) * 0.3::DOUBLE), 6) AS score FROM b LEFT JOIN mem ON mem.id = b.id WHERE seed <> b.id GROUP BY b.id",
)
_BRIDGE = f"""{EDGES}, dg AS (SELECT src, count(*) AS d FROM ed GROUP BY src), sh AS (SELECT a.src, a.dst, count(*) AS n FROM ed a JOIN ed x ON x.src = a.src JOIN ed y ON y.src = a.dst AND y.dst = x.dst GROUP BY a.src, a.dst),
  br AS (SELECT ed.src, ed.dst, weight, coalesce(n, 0) AS shared, CASE WHEN p.d <= 1 AND q.d <= 1 THEN 255 ELSE least(greatest(floor((1 - coalesce(n, 0) / greatest(least(p.d, q.d), 1)) * 255 + 0.5::DOUBLE), 0), 255) END::INT AS bridge
    FROM ed JOIN dg p ON p.src = ed.src JOIN dg q ON q.src = ed.dst LEFT JOIN sh ON sh.src = ed.src AND sh.dst = ed.dst WHERE ed.src < ed.dst)"""
_add("bridge_scores", lambda spark, sf_dir: g.bridges(edges(spark, sf_dir)), f"WITH {_BRIDGE} SELECT src, dst, weight, shared, bridge FROM br")
_add(
    "hebbian_decay",
    lambda spark, sf_dir: g.decayed(g.bridges(edges(spark, sf_dir)).withColumn("weight", F.col("weight") / 20.0), protect=180).select("src", "dst", F.round("weight", 6).alias("weight")),
    f"WITH {_BRIDGE}, f AS (SELECT src, dst, weight / 20 * 0.9::DOUBLE AS w, bridge FROM br) SELECT src, dst, round(CASE WHEN bridge >= 180 THEN greatest(w, 0.1) ELSE w END, 6) AS weight FROM f WHERE w >= 0.1 OR bridge >= 180",
)


def sparse_edges(spark, sf_dir):
    """Memories of one session and language, neighbours linked: many small components."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id", F.get("tags", F.lit(0))).orderBy("id")
    return memories(spark, sf_dir).select(F.lag("id").over(order).alias("src"), F.col("id").alias("dst")).where("src IS NOT NULL")


_add(
    "connected_components",
    lambda spark, sf_dir: g.min_labels(sparse_edges(spark, sf_dir), checkpointed).groupBy("label").agg(F.count("*").alias("n")),
    f"WITH {MEMORIES_SQL} SELECT min(id) AS label, count(*) AS n FROM mem GROUP BY session_id, tags[1] HAVING count(*) > 1",
)
_add(
    "graph_neighborhood",
    lambda spark, sf_dir: g.neighborhood(edges(spark, sf_dir).where("weight > 12"), spark.createDataFrame([(0,), (20,)], "id long")),
    f"""WITH {EDGES}, e AS (SELECT * FROM ed WHERE weight > 12), h0 AS (SELECT * FROM (VALUES (0::BIGINT), (20::BIGINT)) t(node)), h1 AS (SELECT DISTINCT dst AS node FROM e JOIN h0 ON src = node),
      h2 AS (SELECT DISTINCT dst AS node FROM e JOIN h1 ON src = node), u AS (SELECT node, min(h)::INT AS hops FROM (SELECT node, 0 AS h FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node)
      SELECT node, hops FROM u ORDER BY hops, node LIMIT 50""",
)
_add("graph_overview", lambda spark, sf_dir: g.overview(edges(spark, sf_dir)), f"WITH {EDGES} SELECT src, dst, weight FROM ed WHERE src < dst ORDER BY weight DESC, src, dst LIMIT 500")
_add(
    "graph_topology",
    lambda spark, sf_dir: g.topology(edges(spark, sf_dir)),
    f"WITH {EDGES}, d AS (SELECT src, count(*) AS d, sum(weight) AS w FROM ed GROUP BY src) SELECT count(*) AS nodes, (sum(d) / 2)::BIGINT AS edges, round(avg(d), 6) AS mean_degree, max(d) AS largest_degree, round(sum(w) / 2, 6) AS weight FROM d",
)
_add("temporal_chain", lambda spark, sf_dir: g.chain(memories(spark, sf_dir), "session_id", ("ts_ms", "id")).select("id", "previous", "next"), f"WITH {MEMORIES_SQL} SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM mem WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id)")
_add("temporal_chain_pruned", lambda spark, sf_dir: g.chain_pruned(memories(spark, sf_dir), "session_id", ("ts_ms", "id"), "tombstoned").select("id", "previous", "next"), f"WITH {MEMORIES_SQL} SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM mem WHERE NOT tombstoned WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id)")
_add(
    "temporal_candidates",
    lambda spark, sf_dir: g.chain_candidates(memories(spark, sf_dir).select("id", "session_id", "ts_ms"), memories(spark, sf_dir).where("id % 20 = 0").select("id", (F.col("importance") / 10.0).alias("strength")), "session_id", ("ts_ms", "id")).select("id", F.round("score", 6).alias("score")),
    f"""WITH {MEMORIES_SQL}, s AS (SELECT id, session_id, ts_ms, CASE WHEN id % 20 = 0 THEN importance / 10 END AS f FROM mem),
      c AS (SELECT id, unnest([lag(f, 1) OVER w * 0.8::DOUBLE, lag(f, 2) OVER w * 0.8::DOUBLE, lag(f, 3) OVER w * 0.8::DOUBLE, lead(f, 1) OVER w * 0.7::DOUBLE, lead(f, 2) OVER w * 0.7::DOUBLE, lead(f, 3) OVER w * 0.7::DOUBLE]) AS v FROM s WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id))
      SELECT id, round(max(v) * 0.2::DOUBLE, 6) AS score FROM c WHERE v IS NOT NULL GROUP BY id""",
)


def hyperedges(spark, sf_dir):
    """One for each order: the customer (subject) and the order's status (object)."""
    o = read(spark, sf_dir, "orders")
    vertices = F.array(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.lit("SUBJECT").alias("role")), F.struct(F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("entity"), F.lit("TIME").alias("role")))
    return o.select(F.col("o_orderkey").alias("edge_id"), F.lit(0).alias("kind"), F.lit(1.0).alias("weight"), F.col("o_orderkey").alias("memory"), vertices.alias("vertices"))


_HV = "hv AS (SELECT o_orderkey AS memory, 'c' || o_custkey AS c, 'm' || strftime(o_orderdate, '%Y-%m') AS m FROM orders)"
_add("hyperedge_co_occurrence", lambda spark, sf_dir: g.co_occurring(g.hyperedge_vertices(hyperedges(spark, sf_dir))), f"WITH {_HV} SELECT c AS a, m AS b, count(*) AS n FROM hv GROUP BY ALL")
_add(
    "hyperedge_collect",
    lambda spark, sf_dir: g.collected(g.hyperedge_vertices(hyperedges(spark, sf_dir)), spark.createDataFrame([("c1",), ("c20",)], "entity string")).groupBy("start").agg(F.count("*").alias("n"), F.max("memory").alias("last")),
    f"""WITH {_HV}, s AS (SELECT c AS start, memory, c, m FROM hv WHERE c IN ('c1', 'c20')), e AS (SELECT DISTINCT start, unnest([c, m]) AS x FROM s), h AS (SELECT DISTINCT start, hv.memory FROM e JOIN hv ON hv.c = x OR hv.m = x)
      SELECT start, count(*) AS n, max(memory) AS last FROM h GROUP BY start""",
)
_add(
    "hyperedge_boost",
    lambda spark, sf_dir: g.hyperedges_boosted(
        hyperedges(spark, sf_dir), read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.lit("m1995-03").alias("a"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("b"), F.lit(0.25).alias("boost"))
    ).select("edge_id", F.round("weight", 6).alias("weight")),
    f"WITH {_HV} SELECT memory AS edge_id, round(1 + CASE WHEN m = 'm1995-03' AND substr(c, 2)::BIGINT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) THEN 0.25 ELSE 0 END, 6)::DOUBLE AS weight FROM hv",
)


def added_hyperedges(spark, sf_dir):
    """Half of the orders' hyperedges, then all of them, and one without vertices."""
    rows = hyperedges(spark, sf_dir)
    none = rows.limit(1).withColumn("vertices", F.slice("vertices", 1, 0)).withColumn("memory", F.lit(-1).cast(rows.schema["memory"].dataType))
    return g.hyperedges_added(rows.where("edge_id % 2 = 0"), rows.unionByName(none)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("memory").alias("memories"))


_add("hyperedge_add", added_hyperedges, "SELECT 0 AS kind, count(*) AS n, count(DISTINCT o_orderkey) AS memories FROM orders")
_add(
    "hyperedge_decay",
    lambda spark, sf_dir: hyperedges(spark, sf_dir).withColumn("weight", (F.col("edge_id") % 10) / 10.0 * 0.95).where("weight >= 0.5").select("edge_id", F.round("weight", 6).alias("weight")),
    "SELECT o_orderkey AS edge_id, round((o_orderkey % 10) / 10 * 0.95::DOUBLE, 6) AS weight FROM orders WHERE (o_orderkey % 10) / 10 * 0.95::DOUBLE >= 0.5",
)


def refs(spark, sf_dir):
    return memories(spark, sf_dir).select(F.explode("tags").alias("entity"), "id")


_add(
    "entity_fan_candidates",
    lambda spark, sf_dir: g.entity_scores(refs(spark, sf_dir), spark.createDataFrame([(0,), (20,)], "id long"), 0.8).select("id", F.round("score", 6).alias("score")),
    f"""WITH {MEMORIES_SQL}, r AS (SELECT unnest(tags) AS entity, id FROM mem), f AS (SELECT entity, 1 / sqrt(count(*)) AS fan FROM r GROUP BY entity), a AS (SELECT DISTINCT entity FROM r WHERE id IN (0, 20))
      SELECT id, round(max(0.8::DOUBLE * 0.25::DOUBLE * fan), 6) AS score FROM r JOIN a USING (entity) JOIN f USING (entity) GROUP BY id""",
)
_add(
    "contradiction_corrector",
    lambda spark, sf_dir: memories(spark, sf_dir).where("contradicted").select("id", F.round(F.col("importance") / 10.0 + 0.8 * 0.25 * 1.2, 6).alias("score")),
    f"WITH {MEMORIES_SQL} SELECT id, round(importance / 10 + 0.8::DOUBLE * 0.25::DOUBLE * 1.2::DOUBLE, 6) AS score FROM mem WHERE contradicted",
)
_add(
    "entity_fuzzy_merge",
    lambda spark, sf_dir: g.similar_names(read(spark, sf_dir, "documents").select(F.lower(F.regexp_extract("text", r"^[^A-Za-z]*([A-Za-z]{5,})", 1)).alias("name"), F.col("lang").alias("type")).where("name <> ''").distinct()),
    """WITH n AS (SELECT DISTINCT lower(regexp_extract(text, '^[^A-Za-z]*([A-Za-z]{5,})', 1)) AS name, lang AS type FROM documents WHERE regexp_extract(text, '^[^A-Za-z]*([A-Za-z]{5,})', 1) <> '')
      SELECT a.type, a.name AS keep, b.name AS "drop" FROM n a JOIN n b ON a.type = b.type AND (length(a.name) < length(b.name) OR (length(a.name) = length(b.name) AND a.name < b.name)) WHERE levenshtein(a.name, b.name) BETWEEN 1 AND 2""",
)


def relations(spark, sf_dir):
    """nation -IN-> region, supplier -OF-> nation (numbers apart by their kind)."""
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 1000).alias("src"), F.lit("IN").alias("relation"), (F.col("n_regionkey").cast("long") + 2000).alias("dst"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") + 10_000).alias("src"), F.lit("OF").alias("relation"), (F.col("s_nationkey").cast("long") + 1000).alias("dst"))
    return n.unionByName(s)


_REL = "re AS (SELECT n_nationkey::BIGINT + 1000 AS src, 'IN' AS relation, n_regionkey::BIGINT + 2000 AS dst FROM nation UNION ALL SELECT s_suppkey::BIGINT + 10000, 'OF', s_nationkey::BIGINT + 1000 FROM supplier)"
_add(
    "path_search",
    lambda spark, sf_dir: g.paths(relations(spark, sf_dir), spark.createDataFrame([(2000,)], "id long"), hops=3).select("length", "nodes", "relations"),
    f"""WITH RECURSIVE {_REL}, ways AS (SELECT DISTINCT * FROM (SELECT * FROM re UNION ALL SELECT dst, 'INVERSE_' || relation, src FROM re)),
      p AS (SELECT 0 AS length, 2000::BIGINT AS cur, [2000::BIGINT] AS nodes, []::VARCHAR[] AS relations UNION ALL
        SELECT length + 1, dst, list_append(nodes, dst), list_append(relations, relation) FROM p JOIN ways ON cur = src WHERE length < 3 AND NOT list_contains(nodes, dst))
      SELECT length::INT AS length, nodes, relations FROM p WHERE length > 0 ORDER BY length, nodes, relations LIMIT 100""",
)
for _name, _back in (("causal_trace_why", True), ("causal_trace_effects", False)):
    _add(
        _name,
        lambda spark, sf_dir, back=_back: g.causal_chain(edges(spark, sf_dir).withColumn("weight", F.col("weight") / 40.0), spark.createDataFrame([(0,), (20,), (40,)], "id long"), backwards=back),
        f"""WITH RECURSIVE {EDGES}, e AS (SELECT {'dst' if _back else 'src'} AS a, {'src' if _back else 'dst'} AS b, weight / 40 AS w FROM ed),
          c AS (SELECT s AS start, 0 AS step, s AS node, [s] AS seen, 1::DOUBLE AS conf FROM (VALUES (0::BIGINT), (20::BIGINT), (40::BIGINT)) t(s) UNION ALL
            SELECT start, step, node, seen, conf FROM (SELECT c.start, c.step + 1 AS step, b AS node, list_append(seen, b) AS seen, conf * least(greatest(w, 0.1), 1) AS conf, row_number() OVER (PARTITION BY c.start ORDER BY w DESC, b) AS n
              FROM c JOIN e ON a = c.node WHERE c.step < 5 AND NOT list_contains(seen, b)) WHERE n = 1)
          SELECT start, step::INT AS step, node, round(conf, 6) AS confidence FROM c WHERE step > 0""",
    )
