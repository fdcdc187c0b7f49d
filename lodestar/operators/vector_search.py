"""Exact and approximate nearest neighbours, quantizers and clusters over DataFrames.

Vectors come as (id, vector array<double>). A stated set of queries meets all rows in
blocks, and each pair of blocks is one matrix product that keeps the best k for each
query; windows then merge the blocks' best. Queries whose counted bytes are below
QUERY_BYTES go to every task, so that no row's vector is shuffled. More queries are
dealt in blocks: each block of rows meets each block of queries by the numbers of
both. No pair of a query and a row becomes a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as v
from lodestar.sources.lineage import checkpointed

#: Vectors of a block of rows, and of a block of queries.
BLOCK, QUERIES = 4096, 1024
#: The largest query side, in bytes of its vectors, that every task gets.
QUERY_BYTES = 16 << 20
#: Rows of a block of the search for near pairs at most, and rows and columns of a product there.
WIDE, TILE = 1 << 16, 2048
#: Rows that a task holds before it merges the best of its blocks.
HELD = 1_000_000
METRICS = ("cosine", "dot", "l2")


def squared_distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """queries x rows by one product; where that cancels, by the differences."""
    a, b = (queries**2).sum(axis=1)[:, None], (rows**2).sum(axis=1)[None, :]
    square = a - 2 * queries @ rows.T + b
    i, j = np.nonzero(square < 1e-3 * (a + b))
    square[i, j] = ((queries[i] - rows[j]) ** 2).sum(axis=1)
    return square


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """queries x rows, higher is better; l2 as 1 / (1 + distance)."""
    if metric == "cosine":
        a = np.linalg.norm(queries, axis=1, keepdims=True)
        b = np.linalg.norm(rows, axis=1, keepdims=True)
        return (queries / np.where(a > 0, a, 1)) @ (rows / np.where(b > 0, b, 1)).T
    if metric == "dot":
        return queries @ rows.T
    if metric == "l2":
        return 1 / (1 + np.sqrt(squared_distances(queries, rows)))
    raise ValueError(f"unknown metric {metric}")


def best_of(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k rows (query_id, id, score) of each query, ties by id."""
    found = found.iloc[np.lexsort((found["id"], -found["score"], found["query_id"]))]
    return found[found.groupby("query_id").cumcount() < k]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", digits: int = 6, cells: str | None = None) -> DataFrame:
    """query_id, id, score, rank: the best k rows of every query, ties by id.

    rows: id, vector (and a cell column, if the queries have it too: then only rows of
    an equal cell are compared); queries: query_id, vector. Scores are rounded before
    they are ranked. Null vectors and ids are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    cell = [cells] if cells else []
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", "vector", *cell)
    queries = queries.where(F.col("query_id").isNotNull() & F.col("vector").isNotNull()).select("query_id", F.col("vector").alias("query"), *cell)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("query") + 16), F.lit(0)).alias("bytes")).first()

    def product(ids: np.ndarray, own: np.ndarray, names: np.ndarray, asked: np.ndarray) -> pd.DataFrame:
        found = np.round(scores(asked, own, metric), digits) + 0.0  # no negative zero
        best = min(k, len(ids))
        order = np.lexsort((np.broadcast_to(ids, found.shape), -found), axis=1)[:, :best]
        return pd.DataFrame({"query_id": np.repeat(names, best), "id": ids[order].ravel(), "score": np.take_along_axis(found, order, axis=1).ravel()})

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best of a task's blocks, merged whenever many are held."""
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part)
            if n > HELD:
                best = best_of(pd.concat(held), k)
                if len(best) > HELD // 2:  # too many queries to hold
                    yield best
                    held, n = [], 0
                else:
                    held, n = [best], len(best)
        if held:
            yield best_of(pd.concat(held), k)

    kind = "query_id long, id long, score double"
    if size["bytes"] <= QUERY_BYTES:
        sent = queries.toPandas()  # as many bytes as were counted
        groups = dict(list(sent.groupby(cells))) if cells else {None: sent}
        known = {key: (group["query_id"].to_numpy(np.int64), np.array(group["query"].to_list(), dtype=float)) for key, group in groups.items() if len(group)}
        shared = queries.sparkSession.sparkContext.broadcast(known)

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def parts() -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for key, group in frame.groupby(cells) if cells else ((None, frame),):
                        if key not in shared.value:
                            continue
                        for at in range(0, len(group), BLOCK):
                            some = group.iloc[at : at + BLOCK]
                            own = np.array(some["vector"].to_list(), dtype=float)
                            names, asked = shared.value[key]
                            for q in range(0, len(names), QUERIES):
                                yield product(some["id"].to_numpy(np.int64), own, names[q : q + QUERIES], asked[q : q + QUERIES])

            return merged(parts())

        best = rows.mapInPandas(search, kind)
    else:
        query_blocks, row_blocks = max(1, -(-size["n"] // QUERIES)), max(1, -(-rows.count() // BLOCK))
        left = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int"))
        left = left.groupBy("rb", *cell).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
        left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
        right = right.groupBy("qb", *cell).agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
        right = right.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def parts() -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for some, asked in zip(frame["rows"], frame["queries"], strict=True):
                        own, wanted = (np.array([r[c] for r in block], dtype=float) for block, c in ((some, "vector"), (asked, "query")))
                        yield product(np.array([r["id"] for r in some]), own, np.array([q["query_id"] for q in asked]), wanted)

            return merged(parts())

        best = left.join(right, ["rb", "qb", *cell]).select("rows", "queries").mapInPandas(run, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rescored(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, id) ranked again by exact distance, ascending."""
    found = candidates.select("query_id", "id").join(rows.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("query")), "query_id")
    found = found.select("query_id", "id", F.round(v.l2(F.col("vector"), F.col("query")), 6).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ---- scalar quantization ------------------------------------------------------------


def calibration(rows: DataFrame, margin: float = 0.025) -> DataFrame:
    """One row: minimum, step and inverse of each dimension, widened on both sides.

    One pass that sums before its shuffle: a row for each dimension, whatever the data.
    """
    each = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    span = F.col("high") - F.col("low")
    low = F.col("low") - span * margin
    wide = span * (1 + 2 * margin)
    each = each.select("d", low.alias("m"), F.when(wide > 0, wide / 255.0).otherwise(F.lit(1.0)).alias("s"), F.when(wide > 0, F.lit(255.0) / wide).otherwise(F.lit(1.0)).alias("i"))
    ordered = F.sort_array(F.collect_list(F.struct("d", "m", "s", "i")))
    return each.agg(F.transform(ordered, lambda e: e["m"]).alias("minimum"), F.transform(ordered, lambda e: e["s"]).alias("step"), F.transform(ordered, lambda e: e["i"]).alias("inverse"))


def quantized(rows: DataFrame, calibrated: DataFrame) -> DataFrame:
    """id, codes (0..255), decoded; the calibration is one row of fixed size."""
    found = rows.crossJoin(F.broadcast(calibrated))  # one row: no product
    codes = v.to_codes(F.col("vector"), F.col("minimum"), F.col("inverse"))
    return found.withColumn("codes", codes).withColumn("decoded", v.from_codes(F.col("codes"), F.col("minimum"), F.col("step"))).drop("minimum", "step", "inverse")


def _above(bounds: str, n: int) -> Column:
    """How many of the n bounds are below x; a null x is above none."""
    found = F.lit(0)
    for i in range(n):
        found = found + F.coalesce(F.col("x") > F.get(bounds, F.lit(i)), F.lit(False)).cast("int")
    return F.when(F.col(bounds).isNotNull(), found)


def equal_frequency(rows: DataFrame, levels: int = 16) -> DataFrame:
    """d, code, centre, n: buckets of equal frequency in each dimension and their means.

    Cuts are the values of the exact ranks ceil(n * i / levels). Approximate quantiles on
    both sides of each rank only divide a dimension into strata; the strata are counted, and
    the few that hold a rank are ordered, so no dimension's values meet in one task.
    """
    each = rows.select(F.posexplode("vector").alias("d", "x"))
    gap = min(1 / 2000, 1 / (4 * levels))
    around = [i / levels + side for i in range(1, levels) for side in (-gap, gap)]
    bounds = checkpointed(each.groupBy("d").agg(F.percentile_approx("x", around, 10_000).alias("bounds"), F.count("x").alias("n")))
    placed = each.where(F.col("x").isNotNull()).join(F.broadcast(bounds), "d").select("d", "x", "n", _above("bounds", len(around)).alias("stratum"))
    sizes = placed.groupBy("d", "n", "stratum").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("upto", F.sum("size").over(Window.partitionBy("d").orderBy("stratum")))
    ranked = sizes.select("d", "stratum", "upto", (F.col("upto") - F.col("size")).alias("before"), "n", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))).alias("i"))
    ranked = ranked.withColumn("rank", F.expr(f"(n * i + {levels - 1}) div {levels}")).where("before < rank AND rank <= upto")
    wanted = checkpointed(ranked.select("d", "stratum", "i", (F.col("rank") - F.col("before")).alias("rank")))  # a row for each cut
    few = placed.join(F.broadcast(wanted.select("d", "stratum").distinct()), ["d", "stratum"], "left_semi")
    values = few.groupBy("d", "stratum", "x").agg(F.count("*").alias("times"))
    values = values.withColumn("upto", F.sum("times").over(Window.partitionBy("d", "stratum").orderBy("x")))
    found = values.join(F.broadcast(wanted), ["d", "stratum"]).where("upto - times < rank AND rank <= upto")
    cuts = found.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("d", F.transform("c", lambda e: e["x"]).alias("cuts"))
    coded = each.join(F.broadcast(cuts), "d", "left").select("d", _above("cuts", levels - 1).alias("code"), "x")
    return coded.groupBy("d", "code").agg(F.avg("x").alias("centre"), F.count("*").alias("n"))


# ---- rotations and product quantization, by numpy on Arrow batches --------------------


def rotation(dimensions: int, seed: int = 42) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows, a power of two wide, orthonormal."""
    n = x.shape[1]
    if n & (n - 1):
        raise ValueError("the width must be a power of two")
    x = x.astype(float).copy()
    h = 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def turned(rows: DataFrame, transform: str, bits: int = 8, clip: float = 3.0, seed: int = 42) -> DataFrame:
    """Rotate ("turbo") or Hadamard-transform ("svasq"), then code each dimension.

    turbo codes uniformly over +-clip standard deviations of all values; svasq scales
    each dimension by its own deviation. Returns id, codes and the restored vector.
    """
    if transform not in ("turbo", "svasq"):
        raise ValueError(f"unknown transform {transform}")
    first = rows.select(F.size("vector").alias("n")).first()
    width = first["n"] if first else 1
    padded = 1 << max(0, (width - 1).bit_length())
    matrix = rotation(width, seed) if transform == "turbo" else None

    def turn(x: np.ndarray) -> np.ndarray:
        if matrix is not None:
            return x @ matrix
        signs = np.where(np.random.default_rng(seed).random(padded) < 0.5, -1.0, 1.0)
        return hadamard(np.hstack([x, np.zeros((len(x), padded - width))]) * signs)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                y = turn(np.stack(frame["vector"].to_list()))
                n, total, square = n + len(y), total + y.sum(axis=0), square + (y * y).sum(axis=0)
        if n:
            yield pd.DataFrame({"n": [n], "a": [total.tobytes()], "b": [square.tobytes()]})

    sums = rows.select("vector").mapInPandas(moments, "n long, a binary, b binary").collect()  # a row a task, of fixed size
    n = max(1, sum(r["n"] for r in sums))
    size = width if matrix is not None else padded
    mean = sum((np.frombuffer(r["a"]) for r in sums), np.zeros(size)) / n
    spread = np.sqrt(np.maximum(sum((np.frombuffer(r["b"]) for r in sums), np.zeros(size)) / n - mean**2, 1e-18))
    if matrix is not None:
        mean, spread = np.full(size, mean.mean()), np.full(size, np.sqrt((spread**2).mean() + mean.var()))
    top = (1 << bits) - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            y = turn(np.stack(frame["vector"].to_list()))
            codes = np.clip(np.round(((y - mean) / spread / clip + 1) / 2 * top), 0, top).astype(int)
            back = (codes / top * 2 - 1) * clip * spread + mean
            if matrix is not None:
                restored = back @ matrix.T
            else:
                signs = np.where(np.random.default_rng(seed).random(padded) < 0.5, -1.0, 1.0)
                restored = (hadamard(back) * signs)[:, :width]
            yield pd.DataFrame({"id": frame["id"], "codes": list(codes), "restored": list(restored)})

    return rows.select("id", "vector").mapInPandas(run, "id long, codes array<int>, restored array<double>")


def k_means(rows: DataFrame, k: int, iterations: int = 25, seed: int = 42) -> np.ndarray:
    """Centres by the distributed k-means of Spark's library (k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fitted = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="f").fit(rows.select(array_to_vector("vector").alias("f")))
    return np.array(fitted.clusterCenters())


def assigned(rows: DataFrame, centres: np.ndarray, out: str = "cell", n: int = 1) -> DataFrame:
    """The nearest centre of each row (its n nearest, as an array, if n > 1).

    The centres are few by choice (a parameter of the index), not by the data.
    """
    kind = "int" if n == 1 else "array<int>"

    @F.pandas_udf(kind)
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_list())
        distance = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
        if n == 1:
            return pd.Series(distance.argmin(axis=1).astype(np.int32))
        return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return rows.withColumn(out, nearest("vector"))


def ivf_search(rows: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int = 16, k: int = 10, metric: str = "l2") -> DataFrame:
    """Search the cells nearest to a query only; all cells are exact search."""
    cells = assigned(rows, centres)
    asked = assigned(queries, centres, "cell", max(2, min(probes, len(centres)))).withColumn("cell", F.explode(F.slice("cell", 1, min(probes, len(centres)))))
    return top_k(cells, asked, k, metric, cells="cell")


class ProductQuantizer:
    """Codes of one byte for each part of a vector, from centres of the parts."""

    def __init__(self, centres: list[np.ndarray]):
        self.centres = centres

    @classmethod
    def trained(cls, rows: DataFrame, parts: int, k: int = 256, iterations: int = 10, sample: int = 20_000, seed: int = 42) -> ProductQuantizer:
        """Fit on a bounded sample (``sample`` rows or so, by a hash of the id)."""
        n = rows.count()
        some = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
        found = [np.array(r["vector"]) for r in some.orderBy("id").select("vector").collect()]
        x = np.stack(found) if found else np.zeros((1, parts))
        random = np.random.default_rng(seed)
        centres = []
        for part in np.array_split(x, parts, axis=1):
            c = part[random.choice(len(part), min(k, len(part)), replace=False)]
            for _ in range(iterations):
                own = ((part**2).sum(axis=1)[:, None] - 2 * part @ c.T + (c**2).sum(axis=1)[None, :]).argmin(axis=1)
                total = np.zeros_like(c)
                np.add.at(total, own, part)
                number = np.bincount(own, minlength=len(c))
                c = np.where(number[:, None] > 0, total / np.maximum(number, 1)[:, None], c)
            centres.append(c)
        return cls(centres)

    def encode(self, x: np.ndarray) -> np.ndarray:
        pieces = np.array_split(x, len(self.centres), axis=1)
        return np.stack([((p**2).sum(axis=1)[:, None] - 2 * p @ c.T + (c**2).sum(axis=1)[None, :]).argmin(axis=1) for p, c in zip(pieces, self.centres, strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([c[codes[:, j]] for j, c in enumerate(self.centres)])

    def distances(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances by table lookup."""
        pieces = np.array_split(query, len(self.centres))
        return sum(((c - p) ** 2).sum(axis=1)[codes[:, j]] for j, (p, c) in enumerate(zip(pieces, self.centres, strict=True)))

    def encoded(self, rows: DataFrame) -> DataFrame:
        """id, codes and the restored vector."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    codes = self.encode(np.stack(frame["vector"].to_list()))
                    yield pd.DataFrame({"id": frame["id"], "codes": list(codes), "vector": list(self.decode(codes))})

        return rows.select("id", "vector").mapInPandas(run, "id long, codes array<int>, vector array<double>")


def _near_tiles(x: np.ndarray, y: np.ndarray | None, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, surely: places of pairs within the radius or, where not surely, about at it.

    Without y: each pair of x once. One product of a tile is -distance^2 / 2 of all its
    pairs, with an error below the margin.
    """
    other = x if y is None else y
    a, b = (x**2).sum(axis=1) / 2, (other**2).sum(axis=1) / 2
    size = 4 * max(a.max(initial=0), b.max(initial=0))
    margin, kind = (x.shape[1] + 8) * 2.0**-24 * size, np.float32
    if not margin <= radius**2 / 8:
        margin, kind = (x.shape[1] + 8) * 2.0**-53 * size, np.float64
    left = np.hstack([x, -a[:, None], np.ones((len(x), 1))]).astype(kind)
    right = np.hstack([other, np.ones((len(other), 1)), -b[:, None]]).astype(kind)
    limit = -(radius**2) / 2
    for p in range(0, len(left), TILE):
        for q in range(p if y is None else 0, len(right), TILE):
            product = left[p : p + TILE] @ right[q : q + TILE].T
            i, j = np.divmod(np.flatnonzero(product >= limit - margin), product.shape[1])
            surely = product[i, j] >= limit + margin
            if y is None and p == q:
                once = i < j
                i, j, surely = i[once], j[once], surely[once]
            if len(i):
                yield i + p, j + q, surely


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, by their differences, some at a time."""
    parts = [np.sqrt(((x[i[k : k + HELD // 16]] - y[j[k : k + HELD // 16]]) ** 2).sum(axis=1)) for k in range(0, len(i), HELD // 16)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _within(x: np.ndarray, y: np.ndarray | None, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within the radius, tile by tile."""
    for i, j, near in _near_tiles(x, y, radius):
        about = np.flatnonzero(~near)
        near[about] = _distances(x, x if y is None else y, i[about], j[about]) <= radius
        yield i[near], j[near]


def _near_groups(rows: DataFrame, radius: float, centres: np.ndarray, found: Callable, kind: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """What ``found`` makes of groups of rows in which each pair within the radius meets once.

    Blocking without loss: a row sits in the cell of its nearest centre and visits each other
    cell that a row within the radius may sit in (beyond the plane between both centres by
    the radius at most). A pair of two cells is looked for among the rows of both that visit
    the other's cell. Cells are cut in blocks of a share of all rows (BLOCK at least, WIDE at
    most), and each two blocks of two such cells, or of one cell, are a group: a row is copied
    as often as there are blocks to meet, and no cell is one task. Rows come with the
    ``carried`` columns (long); rows without an id or a finite vector are near none.
    """
    between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["vector"].to_list()).astype(float) if len(frame) else np.zeros((0, centres.shape[1]))
            finite = np.isfinite(x).all(axis=1)
            x, frame = x[finite], frame[finite]
            if len(frame):
                own = (x**2).sum(axis=1)[:, None]
                d = own - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
                cell = d.argmin(axis=1)
                visits = d - d.min(axis=1, keepdims=True) <= 2 * radius * between[cell] + 1e-9 * (1 + own + np.abs(d))
                yield frame[["id", *carried]].assign(vector=[r.tobytes() for r in x], cell=cell, others=[np.flatnonzero(row).astype(np.int32) for row in visits])

    columns = "id long, " + "".join(f"{c} long, " for c in carried)
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", *carried, "vector")
    at = checkpointed(rows.mapInPandas(placed, columns + "vector binary, cell int, others array<int>"))
    # There are few cells (a parameter), so their counts are a short list.
    counts = {r["cell"]: r["n"] for r in at.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    size = max(BLOCK, min(WIDE, -(-sum(counts.values()) // 8)))
    blocks = [max(1, -(-counts.get(c, 0) // size)) for c in range(len(centres))]
    number = sum(blocks) * (sum(blocks) + 1) // 2

    def of(cell: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in blocks]), F.col(cell) + 1)

    copies = at.withColumn("block", F.pmod(F.xxhash64("id"), of("cell")).cast("int")).withColumn("other", F.explode("others")).drop("others")
    copies = copies.withColumn("to", F.explode(F.sequence(F.lit(0), of("other") - 1)))
    first = (F.col("cell") < F.col("other")) | ((F.col("cell") == F.col("other")) & (F.col("block") <= F.col("to")))
    here, there = F.struct(F.col("cell").alias("c"), F.col("block").alias("b")), F.struct(F.col("other").alias("c"), F.col("to").alias("b"))
    copies = copies.select(F.when(first, here).otherwise(there).alias("lower"), F.when(first, there).otherwise(here).alias("upper"), first.alias("first"), "id", *carried, "vector")
    copies = copies.select(F.col("lower.c").alias("c"), F.col("lower.b").alias("b"), F.col("upper.c").alias("d"), F.col("upper.b").alias("e"), "first", "id", *carried, "vector")
    group = ["c", "b", "d", "e"]

    def meeting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(key: tuple, sides: dict) -> Iterator[pd.DataFrame]:
            alone = key[:2] == key[2:]
            if True not in sides or not (alone or False in sides):
                return iter(())
            both = []
            for side in (True,) if alone else (True, False):
                heads = pd.concat([h for h, _ in sides[side]])
                both.append((heads.reset_index(drop=True), np.concatenate([x for _, x in sides.pop(side)])))
            return found(*both) if len(both) == 2 else found(both[0], None)

        now, sides = None, {}
        for frame in frames:
            for *key, some in ((*k, g) for k, g in frame.groupby([*group, "first"], sort=True)):
                key = key[0] if len(key) == 1 else tuple(key)
                if key[:4] != now:
                    if now is not None:
                        yield from whole(now, sides)
                    now, sides = key[:4], {}
                x = np.frombuffer(b"".join(some["vector"]), float).reshape(len(some), -1)
                sides.setdefault(bool(key[4]), []).append((some[["id", *carried]], x))
        if now is not None:
            yield from whole(now, sides)

    return copies.repartition(min(number, 1024), *group).sortWithinPartitions(*group, "first", "id").mapInPandas(meeting, kind)


def near_pairs(rows: DataFrame, radius: float, centres: np.ndarray) -> DataFrame:
    """a, b, distance of all pairs within the radius, a < b (see ``_near_groups``). Ids are
    unique, so each pair is found once. A radius that most pairs are within gives most
    pairs, by its nature; ``near_links`` and ``near_older`` don't list them.
    """

    def found(left: tuple, right: tuple | None) -> Iterator[pd.DataFrame]:
        (heads, x), (others, y) = left, right or left
        ids, names = heads["id"].to_numpy(), others["id"].to_numpy()
        for i, j, _ in _near_tiles(x, y if right else None, radius):
            d = _distances(x, y, i, j)
            i, j, d = i[d <= radius], j[d <= radius], d[d <= radius]
            yield pd.DataFrame({"a": np.minimum(ids[i], names[j]), "b": np.maximum(ids[i], names[j]), "distance": d})

    return _near_groups(rows, radius, centres, found, "a long, b long, distance double")


def near_links(rows: DataFrame, radius: float, centres: np.ndarray) -> DataFrame:
    """src, dst: links with the connected components of all pairs within the radius, no more
    from a group of rows than it has rows. Which links they are follows the order of a group's
    rows, so rows are ordered by id and the links are written once, to be read again."""

    def found(left: tuple, right: tuple | None) -> Iterator[pd.DataFrame]:
        ids = np.concatenate([side[0]["id"].to_numpy() for side in (left, right) if side])
        shift = len(left[1]) if right else 0
        label, held, n = np.arange(len(ids)), [], 0

        def joined() -> np.ndarray:
            own = label
            for u, v in held:
                while True:
                    low, high = np.minimum(own[u], own[v]), np.maximum(own[u], own[v])
                    apart = low < high
                    if not apart.any():
                        break
                    u, v = u[apart], v[apart]
                    np.minimum.at(own, high[apart], low[apart])
                    while (own[own] != own).any():
                        own = own[own]
            return own

        for i, j in _within(left[1], right[1] if right else None, radius):
            held.append((i, j + shift))
            n += len(i)
            if n > HELD:
                label, held, n = joined(), [], 0
        label = joined()
        linked = np.flatnonzero(label != np.arange(len(ids)))
        yield pd.DataFrame({"src": ids[label[linked]], "dst": ids[linked]})

    return checkpointed(_near_groups(rows, radius, centres, found, "src long, dst long"))


def near_older(rows: DataFrame, radius: float, centres: np.ndarray) -> DataFrame:
    """id: the rows (id, vector, t, n) with a row within the radius that is later by (t, n)."""

    def found(left: tuple, right: tuple | None) -> Iterator[pd.DataFrame]:
        heads = pd.concat([side[0] for side in (left, right) if side])
        shift = len(left[1]) if right else 0
        rank = np.empty(len(heads), np.int64)
        rank[np.lexsort((heads["n"], heads["t"]))] = np.arange(len(heads))
        older = np.zeros(len(heads), bool)
        for i, j in _within(left[1], right[1] if right else None, radius):
            older[np.where(rank[i] < rank[j + shift], i, j + shift)] = True
        yield pd.DataFrame({"id": heads["id"].to_numpy()[older]})

    return _near_groups(rows, radius, centres, found, "id long", ("t", "n")).distinct()


def principal(rows: DataFrame, k: int = 3) -> DataFrame:
    """id, projected: the first principal components, by Spark's library."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select("id", array_to_vector("vector").alias("f"))
    return PCA(k=k, inputCol="f", outputCol="p").fit(data).transform(data).select("id", vector_to_array("p").alias("projected"))
