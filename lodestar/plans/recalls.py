"""Recall steps after the scan, ingestion with parents, write path."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import bits, scoring, vectors as v
from lodestar.operators import chunking, graph, lexical, pathway
from lodestar.operators import recall as r
from lodestar.operators import vector_search as vs
from lodestar.plans.scoring import _RESULTS, results
from lodestar.plans.vectors import asked, base
from lodestar.sources.memories import EMBEDDED_SQL, MEMORIES_SQL, embedded, memories, read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


def _tag_edges(spark, sf_dir):
    rows = memories(spark, sf_dir).select("session_id", "ts_ms", "id", F.get("tags", F.lit(1)).alias("tag"))
    return graph.stdp(rows, "session_id", ("ts_ms", "id"), "tag", "ts_ms", tau_ms=3.6e7)


_STDP = f"""{MEMORIES_SQL}, l AS (SELECT lag(tags[2]) OVER w AS s, tags[2] AS d, ts_ms - lag(ts_ms) OVER w AS gap FROM mem WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id)), f AS (SELECT * FROM l WHERE s <> d),
  u AS (SELECT s AS src, d AS dst, 0.1::DOUBLE * exp(-gap / 3.6e7) AS w FROM f UNION ALL SELECT d, s, -0.05::DOUBLE * exp(-gap / 3.6e7) FROM f), ed AS (SELECT src, dst, least(greatest(sum(w), 0), 1) AS weight FROM u GROUP BY ALL)"""


def _ranked(spark, sf_dir):
    return lexical.ranked(results(spark, sf_dir).select("query_id", "id", "score"), None)


_add(
    "predictive_boost",
    lambda spark, sf_dir: r.predictive_boost(_ranked(spark, sf_dir), memories(spark, sf_dir), _tag_edges(spark, sf_dir)).select("query_id", "id", F.round("score", 5).alias("score")),
    f"""{_RESULTS}, {_STDP.replace(MEMORIES_SQL + ', ', '')}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM res), t AS (SELECT k.*, tags FROM k JOIN mem USING (id)),
      b AS (SELECT DISTINCT query_id, unnest(tags) AS src FROM t WHERE n <= 3), a AS (SELECT query_id, id, unnest(tags) AS dst FROM t), g AS (SELECT a.query_id, a.id, max(weight) AS w FROM b JOIN ed USING (src) JOIN a ON a.query_id = b.query_id AND a.dst = ed.dst GROUP BY a.query_id, a.id)
      SELECT k.query_id, k.id, round(score * (1 + coalesce(w, 0) * 0.3::DOUBLE), 5) AS score FROM k LEFT JOIN g USING (query_id, id)""",
)


def associative(spark, sf_dir):
    """The mask of tags associated with what the last memories were about."""
    recent = memories(spark, sf_dir).orderBy(F.desc("ts_ms"), "id").limit(20).select("tags", (F.row_number().over(Window.orderBy(F.desc("ts_ms"), "id")) - 1).alias("age"))
    recent = recent.select(F.explode("tags").alias("tag"), "age")
    pairs = graph.associated(graph.co_activation(memories(spark, sf_dir)))
    own = memories(spark, sf_dir).select(F.explode("tags").alias("tag")).distinct()
    bit = own.select("tag", bits.tag_filter(F.array("tag")).alias("bit"))
    return r.associative_mask(recent, pairs, bit).select("tags")


_add(
    "associative_tags",
    associative,
    f"""WITH {MEMORIES_SQL}, n AS (SELECT tags, row_number() OVER (ORDER BY ts_ms DESC, id) - 1 AS age FROM mem), w AS (SELECT tag, max(pow(0.85::DOUBLE, age)) AS w FROM (SELECT unnest(tags) AS tag, age FROM n WHERE age < 20) GROUP BY tag),
      p AS (SELECT least(tags[1], tags[2]) AS a, greatest(tags[1], tags[2]) AS b, count(*) AS n FROM mem WHERE tags[1] <> tags[2] GROUP BY ALL), u AS (SELECT a AS tag, b AS other, n FROM p UNION ALL SELECT b, a, n FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS place FROM u), s AS (SELECT other, max(w * n) AS s FROM w JOIN k USING (tag) WHERE place <= 5 GROUP BY other),
      t AS (SELECT other FROM s ORDER BY s DESC, other LIMIT 10) SELECT list_sort(list(other)) AS tags FROM t""",
)


def _u(k, n):
    return (F.col("id") * k % n) / F.lit(float(n))


_add(
    "importance_provider",
    lambda spark, sf_dir: r.importance_of(memories(spark, sf_dir).drop("importance", "pinned"), _u(11, 13), (_u(7, 10), _u(3, 7), _u(5, 9)), 1.0 + _u(2, 5), F.lit(1.1), F.lit(1.0), (F.col("id") % 50) / 12.0).select("id", F.round("importance", 6).alias("importance"), "pinned"),
    f"""WITH {MEMORIES_SQL}, h AS (SELECT id, (id * 7 % 10) / 10 AS i, (id * 3 % 7) / 7 AS c, (id * 11 % 13) / 13 AS n, (id * 5 % 9) / 9 AS u, 1 + (id * 2 % 5) / 5 AS t, (id % 50) / 12 AS z FROM mem),
      b AS (SELECT *, least(greatest(0.05::DOUBLE + 9.95::DOUBLE / (1 + exp(-8 * (0.3::DOUBLE * i * n + 0.1::DOUBLE * c + 0.2::DOUBLE * u - 0.2::DOUBLE))), 0.05), 10) AS b FROM h)
      SELECT id, round(CASE WHEN z > 3 THEN 10 ELSE least(greatest(b * t * 1.1::DOUBLE, 0.05), 10) END, 6) AS importance, z > 3 AS pinned FROM b""",
)


def free_energy(spark, sf_dir):
    rows = vs.top_k(base(spark, sf_dir), asked(spark, sf_dir), 20, "cosine").select("query_id", "id", F.col("score").alias("similarity"))
    rows = rows.withColumn("gain", (F.col("id") % 7) / 3.0 - 1.0).withColumn("affect", (F.col("id") % 5) / 5.0)
    return r.workspace(r.free_energy_rerank(rows)).select("query_id", "id", F.round("score", 9).alias("score"), "place")


_add(
    "free_energy_workspace",
    free_energy,
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(q.v, e.v), 6) AS s FROM e q, e WHERE q.id % 20 = 0),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM x) WHERE n <= 20),
      f AS (SELECT query_id, id, 0.5::DOUBLE * s + 0.3::DOUBLE / (1 + exp(-((id % 7) / 3 - 1))) + 0.2::DOUBLE * ((id % 5) / 5) AS s FROM t)
      SELECT query_id, id, round(s, 9) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM f) WHERE place <= 7""",
)
_add("replay_scores", lambda spark, sf_dir: r.replay_scores(memories(spark, sf_dir).where("memory_type = 'EPISODIC'")).select("id", "score"), f"WITH {MEMORIES_SQL} SELECT id, 0.5::DOUBLE AS score FROM mem WHERE memory_type = 'EPISODIC'")
_add("parent_child_chunks", lambda spark, sf_dir: chunking.parents(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("id").agg(F.count("*").alias("children"), F.max("parent").alias("last_parent")))
_add(
    "write_path",
    lambda spark, sf_dir: embedded(spark, sf_dir).select("id", F.round(v.magnitude(F.col("vector")), 5).alias("norm"), bits.header_flags(F.col("tombstoned"), F.col("memory_type"), F.lit(False), F.col("pinned"), F.lit(False)).alias("flags"), F.size(v.to_codes(v.normalize(F.col("vector")), F.transform("vector", lambda x: F.lit(-1.0)), F.transform("vector", lambda x: F.lit(127.5)))).alias("codes")),
    f"WITH {EMBEDDED_SQL} SELECT id, round(sqrt(list_dot_product(vector, vector)), 5) AS norm, (tombstoned::INT | (CASE memory_type WHEN 'WORKING' THEN 0 WHEN 'EPISODIC' THEN 2 WHEN 'SEMANTIC' THEN 4 ELSE 6 END) | (pinned::INT << 4))::INT AS flags, len(vector)::INT AS codes FROM emb",
)


def dense_sparse(spark, sf_dir):
    """Sparse vectors from dense ones (the positive numbers above .15), searched by dot product."""
    rows = base(spark, sf_dir).select("id", F.posexplode("vector").alias("d", "weight")).where("weight > 0.15").select("id", F.concat(F.lit("d"), F.col("d").cast("string")).alias("term"), "weight")
    return lexical.sparse_dot(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5)


_add(
    "dense_derived_sparse",
    dense_sparse,
    """WITH s AS (SELECT id, i, v[i] AS w FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE v[i] > 0.15),
      b AS (SELECT q.id AS query_id, s.id, round(sum(s.w * q.w), 6) AS score FROM s JOIN s q USING (i) WHERE q.id % 20 = 0 GROUP BY ALL)
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 5""",
)


def pathway_recall(spark, sf_dir):
    """Scan, weigh, sort and cut as a pathway whose graph step is gated off."""
    path = (
        pathway.Pathway()
        .relay("scan", lambda df: df.where("NOT tombstoned"))
        .gated("graph", lambda df: "graph_weight" in df.columns, lambda df: df.withColumn("score", F.col("graph_weight")))
        .relay("weigh", lambda df: df.withColumn("score", F.round(F.col("importance") * scoring.confidence_of(F.col("provenance")), 6)))
        .relay("broken", lambda df: df.select("no_such_column"), policy="DEGRADE")
        .consolidate("cut", lambda df: df.orderBy(F.desc("score"), "id").limit(25))
    )
    return path.run(memories(spark, sf_dir)).select("id", "score")


_add(
    "pathway_recall",
    pathway_recall,
    f"""WITH {MEMORIES_SQL} SELECT id, round(importance * (CASE provenance WHEN 'OBSERVED' THEN 0.9 WHEN 'USER_STATED' THEN 1 WHEN 'REFLECTED' THEN 0.7 WHEN 'INFERRED' THEN 0.5 WHEN 'PROCEDURAL' THEN 1 ELSE 0.6 END)::DOUBLE, 6) AS score
      FROM mem WHERE NOT tombstoned ORDER BY score DESC, id LIMIT 25""",
)
