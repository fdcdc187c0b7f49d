"""Vector kernels, searches, quantizers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import vectors as v
from lodestar.operators import vector_search as s
from lodestar.sources.memories import read

REGISTERED: dict = {}


def _add(name, query, sql=None):
    REGISTERED[name] = (query, sql)


def base(spark, sf_dir):
    """id, vector, label of all vectors."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def asked(spark, sf_dir):
    """The stated queries: the vectors whose id is divisible by 20."""
    return base(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def pairs(spark, sf_dir):
    """Each vector with the one after it: a and b."""
    rows = base(spark, sf_dir)
    return rows.select("id", F.col("vector").alias("a")).join(rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b")), "id")


E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
P = E + ", p AS (SELECT x.id, x.v AS a, y.v AS b FROM e x JOIN e y ON y.id = x.id + 1)"


def _pairwise(name, expression, sql):
    _add(name, lambda spark, sf_dir: pairs(spark, sf_dir).select("id", F.round(expression(F.col("a"), F.col("b")), 6).alias("value")), f"WITH {P} SELECT id, round({sql}, 6) AS value FROM p")


def _sum(expression: str, *lists: str) -> str:
    """Sum over places i of an expression over lists."""
    return f"list_sum([{expression} for i in range(1, len({lists[0]}) + 1)])"


_pairwise("vector_dot", v.dot, "list_dot_product(a, b)")
_pairwise("vector_cosine", v.cosine, "list_cosine_similarity(a, b)")
_pairwise("vector_l2", v.l2, "list_distance(a, b)")
_pairwise("vector_squared_l2", v.squared_l2, "pow(list_distance(a, b), 2)")
_pairwise("affective_distance", lambda a, b: v.gaussian_kernel(a, b, 0.7), "exp(-pow(list_distance(a, b), 2) / (2 * 0.7::DOUBLE * 0.7::DOUBLE))")


def _precision(a):
    return F.transform(a, lambda x: 1.0 + F.abs(x))


_PA, _PB = "(1 + abs(a[i]))", "(1 + abs(b[i]))"
_pairwise("free_energy_kl", lambda a, b: v.gaussian_kl(a, _precision(a), b, _precision(b)), _sum(f"0.5::DOUBLE * (ln({_PA} / {_PB}) + {_PB} / {_PA} + {_PB} * (a[i] - b[i]) * (a[i] - b[i]) - 1)", "a"))
_pairwise("free_energy_nll", lambda a, b: v.gaussian_nll(a, b, _precision(b)), _sum(f"0.5::DOUBLE * ({_PB} * (a[i] - b[i]) * (a[i] - b[i]) - ln({_PB}) + 1.8378770664093453::DOUBLE)", "a"))
_pairwise("prediction_error_energy", lambda a, b: v.error_energy(a, b, _precision(a)), _sum(f"0.5::DOUBLE * {_PA} * (a[i] - b[i]) * (a[i] - b[i])", "a"))
_pairwise("precision_fusion", lambda a, b: v.magnitude(v.fused_precision_mean(a, _precision(a), b, _precision(b))), f"sqrt({_sum(f'pow((a[i] * {_PA} + b[i] * {_PB}) / ({_PA} + {_PB}), 2)', 'a')})")
_pairwise(
    "manifold_distance",
    lambda a, b: F.exp(-v.manifold_squared(a, b, F.transform(a, lambda x: F.lit(0.5)), [F.transform(a, lambda x, i: F.when(i < 8, F.lit(0.3)).otherwise(F.lit(0.0)))]) / F.lit(2.0)),
    f"exp(-({_sum('0.5::DOUBLE * pow(a[i] - b[i], 2)', 'a')} + pow(list_sum([0.3::DOUBLE * (a[i] - b[i]) for i in range(1, 9)]), 2)) / 2)",
)
_add(
    "vector_ops",
    lambda spark, sf_dir: pairs(spark, sf_dir).select(
        "id",
        F.round(v.magnitude(v.add(F.col("a"), F.col("b"))), 6).alias("sum_length"),
        F.round(v.magnitude(v.subtract(F.col("a"), F.col("b"))), 6).alias("gap_length"),
        F.round(v.magnitude(v.scale(F.col("a"), F.lit(2.5))), 6).alias("scaled_length"),
        F.round(v.magnitude(v.normalize(v.add(F.col("a"), F.col("b")))), 6).alias("unit_length"),
    ),
    f"""WITH {P} SELECT id, round(sqrt({_sum('pow(a[i] + b[i], 2)', 'a')}), 6) AS sum_length, round(list_distance(a, b), 6) AS gap_length,
      round(2.5::DOUBLE * sqrt(list_dot_product(a, a)), 6) AS scaled_length, 1::DOUBLE AS unit_length FROM p""",
)

for _metric, _sql in (("cosine", "list_cosine_similarity(q.v, e.v)"), ("dot", "list_dot_product(q.v, e.v)"), ("l2", "1 / (1 + list_distance(q.v, e.v))")):
    _add(
        f"top_k_{_metric}",
        lambda spark, sf_dir, metric=_metric: s.top_k(base(spark, sf_dir), asked(spark, sf_dir), 10, metric),
        f"""WITH {E}, x AS (SELECT q.id AS query_id, e.id, round({_sql}, 6) AS score FROM e q, e WHERE q.id % 20 = 0)
          SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10""",
    )

_CAL = """d AS (SELECT id, i, v[i] AS x FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM e)),
  c AS (SELECT i, min(x) - (max(x) - min(x)) * 0.025::DOUBLE AS m, (max(x) - min(x)) * 1.05::DOUBLE AS w FROM d GROUP BY i),
  k AS (SELECT id, d.i, least(255, greatest(0, floor((x - m) * (255 / w) + 0.5::DOUBLE)))::INT AS q, m, w FROM d JOIN c USING (i))"""
_add(
    "int8_quantize",
    lambda spark, sf_dir: s.quantized(base(spark, sf_dir), s.calibration(base(spark, sf_dir))).select("id", "codes", F.round(v.l2(F.col("vector"), F.col("decoded")), 5).alias("error")),
    f"""WITH {E}, {_CAL}, b AS (SELECT id, list(q ORDER BY i) AS codes, list(q * (w / 255) + m ORDER BY i) AS back FROM k GROUP BY id)
      SELECT b.id, codes, round(list_distance(back, v), 5) AS error FROM b JOIN e USING (id)""",
)


def quantized_search(spark, sf_dir):
    """Oversampled candidates by decoded codes, ranked again by exact distance."""
    rows = base(spark, sf_dir)
    coded = s.quantized(rows, s.calibration(rows)).select("id", F.col("decoded").alias("vector"))
    return s.rescored(s.top_k(coded, asked(spark, sf_dir), 30, "l2"), rows, asked(spark, sf_dir), 10)


_add(
    "quantized_rescore",
    quantized_search,
    f"""WITH {E}, {_CAL}, b AS (SELECT id, list(q * (w / 255) + m ORDER BY i) AS back FROM k GROUP BY id),
      x AS (SELECT q.id AS query_id, b.id, round(1 / (1 + list_distance(q.v, back)), 6) AS s FROM e q, b WHERE q.id % 20 = 0),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM x) WHERE n <= 30),
      y AS (SELECT query_id, t.id, round(list_distance(q.v, e.v), 6) AS distance FROM t JOIN e ON t.id = e.id JOIN e q ON q.id = query_id)
      SELECT query_id, id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM y) WHERE rank <= 10""",
)


def packing(spark, sf_dir):
    """Codes of four and two bits, packed and unpacked."""
    rows = base(spark, sf_dir)
    codes = s.quantized(rows, s.calibration(rows)).select("id", F.transform("codes", lambda q: F.shiftright(q, 4)).alias("n4"), F.transform("codes", lambda q: F.shiftright(q, 6)).alias("n2"))
    rows = codes.select("id", "n4", "n2", v.packed(F.col("n4"), 4).alias("nibbles"), v.packed(F.col("n2"), 2).alias("crumbs"))
    return rows.select("id", "nibbles", "crumbs", (v.unpacked(F.col("nibbles"), 4) == F.col("n4")).alias("same4"), (v.unpacked(F.col("crumbs"), 2) == F.col("n2")).alias("same2"))


_add(
    "nibble_crumb_packing",
    packing,
    f"""WITH {E}, {_CAL}, b AS (SELECT id, list(q >> 4 ORDER BY i) AS n4, list(q >> 6 ORDER BY i) AS n2 FROM k GROUP BY id)
      SELECT id, [(n4[2 * i + 1] | (n4[2 * i + 2] << 4))::INT for i in range(0, len(n4) // 2)] AS nibbles,
        [(n2[4 * i + 1] | (n2[4 * i + 2] << 2) | (n2[4 * i + 3] << 4) | (n2[4 * i + 4] << 6))::INT for i in range(0, len(n2) // 4)] AS crumbs, true AS same4, true AS same2 FROM b""",
)
_add(
    "equal_frequency_quantize",
    lambda spark, sf_dir: s.equal_frequency(base(spark, sf_dir)).select("d", "code", F.round("centre", 4).alias("centre"), "n"),
    f"""WITH {E}, x AS (SELECT unnest(range(0, len(v))) AS d, unnest(v) AS x FROM e), c AS (SELECT d, quantile_disc(x, [{', '.join(f'{i / 16}' for i in range(1, 16))}]) AS cuts FROM x GROUP BY d)
      SELECT d::INT AS d, len(list_filter(cuts, lambda c: x.x > c))::INT AS code, round(avg(x), 4) AS centre, count(*) AS n FROM x JOIN c USING (d) GROUP BY ALL""",
)
for _kind in ("turbo", "svasq"):
    for _bits in (8, 4, 2):
        _add(f"{_kind}_quantize_{_bits}", lambda spark, sf_dir, kind=_kind, bits=_bits: s.turned(base(spark, sf_dir), kind, bits).select("id", "codes", F.round(F.aggregate("restored", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length")))

_CENTRES = "c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i) GROUP BY label)"


#: Cells of an index by label: their centres go to the driver and to every task.
CELLS = 65_536


def label_centres(spark, sf_dir) -> np.ndarray:
    """The mean vector of each label: as many as there are labels, CELLS at most."""
    if base(spark, sf_dir).select("label").distinct().count() > CELLS:
        raise ValueError(f"more than {CELLS} labels: choose centres by k_means instead")
    each = base(spark, sf_dir).select("label", F.posexplode("vector").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    rows = each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("m")).orderBy("label").collect()
    return np.array([[e["x"] for e in r["m"]] for r in rows])


_add(
    "centroid_assign",
    lambda spark, sf_dir: s.assigned(base(spark, sf_dir), label_centres(spark, sf_dir)).select("id", "cell"),
    f"""WITH {E}, {_CENTRES}, n AS (SELECT label, m, row_number() OVER (ORDER BY label) - 1 AS cell FROM c)
      SELECT id, arg_min(cell, list_distance(v, m))::INT AS cell FROM e, n GROUP BY id""",
)
_add(
    "ivf_flat_search",
    lambda spark, sf_dir: s.ivf_search(base(spark, sf_dir), asked(spark, sf_dir), label_centres(spark, sf_dir), probes=8),
    f"""WITH {E}, {_CENTRES}, d AS (SELECT id, v, label AS cell, list_distance(v, m) AS g FROM (SELECT e.id, e.v, c.label, c.m FROM e, c)),
      own AS (SELECT id, v, arg_min(cell, g) AS cell FROM d GROUP BY id, v),
      ask AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, cell) AS n FROM d WHERE id % 20 = 0) WHERE n <= 8),
      x AS (SELECT ask.id AS query_id, own.id, round(1 / (1 + list_distance(ask.v, own.v)), 6) AS score FROM ask JOIN own USING (cell))
      SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10""",
)


def spectrum_search(spark, sf_dir):
    """k-means cells, several probes, oversampling, exact ranking."""
    rows = base(spark, sf_dir)
    found = s.ivf_search(rows, asked(spark, sf_dir), s.k_means(rows, 16), probes=14, k=30)
    return s.rescored(found, rows, asked(spark, sf_dir), 10)


def ivf_pq_search(spark, sf_dir):
    """Product-quantized residuals of cells, asymmetric distances by restored vectors, exact ranking."""
    rows = base(spark, sf_dir)
    centres = label_centres(spark, sf_dir)
    cells = s.assigned(rows, centres)
    lists = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    residual = cells.select("id", "cell", v.subtract(F.col("vector"), F.element_at(lists, F.col("cell") + 1)).alias("vector"))
    quantizer = s.ProductQuantizer.trained(residual, parts=16, k=64)
    restored = quantizer.encoded(residual).select("id", F.col("vector").alias("r")).join(cells.select("id", "cell"), "id")
    restored = restored.select("id", "cell", v.add(F.col("r"), F.element_at(lists, F.col("cell") + 1)).alias("vector"))
    wanted = s.assigned(asked(spark, sf_dir), centres, "cell", len(centres)).withColumn("cell", F.explode(F.array("cell") if len(centres) == 1 else "cell"))
    found = s.rescored(s.top_k(restored, wanted, 100, "l2", cells="cell"), rows, asked(spark, sf_dir), 10)
    return found.select("query_id", "id", F.round(1 / (1 + F.col("distance")), 6).alias("score"), "rank")


_add("spectrum_search", spectrum_search)
_add("ivf_pq_search", ivf_pq_search)
_add("pq_encode", lambda spark, sf_dir: s.ProductQuantizer.trained(base(spark, sf_dir), 8, 32).encoded(base(spark, sf_dir)).select("id", "codes"))
_add("k_means_cells", lambda spark, sf_dir: s.assigned(base(spark, sf_dir), s.k_means(base(spark, sf_dir), 10)).groupBy("cell").agg(F.count("*").alias("n")))
_add("principal_projection", lambda spark, sf_dir: s.principal(base(spark, sf_dir)).select("id", F.transform("projected", lambda x: F.round(F.abs(x), 4)).alias("projected")))
_add(
    "near_duplicate_vectors",
    lambda spark, sf_dir: s.near_pairs(base(spark, sf_dir), 1.1, label_centres(spark, sf_dir)).select("a", "b", F.round("distance", 5).alias("distance")),
    f"WITH {E} SELECT x.id AS a, y.id AS b, round(list_distance(x.v, y.v), 5) AS distance FROM e x JOIN e y ON x.id < y.id WHERE list_distance(x.v, y.v) <= 1.1",
)
