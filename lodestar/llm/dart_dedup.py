"""Near-duplicates by DartMinHash signatures, a banded join and exact checks.

Sketch. Every element (a hashed shingle) owns a region: its weight wide, time long.
Darts fall on all regions at rate one, their number, time, height and coordinate
given by hashes of the element and of the unit cell that they fall into, so that a
dart is the same for every document that holds its element. A dart counts if its
height is below the element's weight. Of each coordinate the earliest dart is kept:
two documents agree on it with the probability of their weighted Jaccard
similarity. Time is cut at (ln k + 2) k / total weight, by when each of the k
coordinates almost surely has a dart (if not, time is doubled): about k ln k darts
whatever the length of the text. A text's elements are its five-word shingles, each
weighing as much as it occurs (``weights="count"``) or, as a set, one.

Join. BANDS bands of ROWS coordinates; texts that agree on a band share a bucket. At
a similarity of 0.8 a pair misses all 64 bands of 8 with a probability of 8e-6.

Exact links without all pairs of a group. Exact copies are one node (grouped by md5)
from the start. In each bucket all nodes are held against one centre, and pairs are
checked exactly on the whole sets of shingles. The classes so far settle most
buckets: all their nodes are in one class. Others get new centres as long as that
helps. Keys that many rows share (a bucket, a text, a class) meet their rows by a
broadcast of the few hot keys. What is then left is compared exactly, but only between nodes of different
classes that share a bucket, and in blocks where that is many. No link between
classes is lost, none within one matters to the result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import by_host, checkpointed, internal, met, small, table, text_of, written
from lodestar.llm.components import components
from lodestar.llm.shingles import WORDS, mixed, shingles

SIMILARITY = 0.8
BANDS, ROWS = 64, 8
#: An element's weight: its occurrences ("count") or one ("one").
WEIGHTS = "count"
#: What rounding may take from a similarity that is the threshold exactly.
EDGE = 1e-9
#: Further rounds of centres at most; what they leave is checked pair by pair.
ROUNDS = 3
#: Buckets with more pairs than this between classes are compared in blocks.
PAIRS = 64
#: Bytes of the sets of a block, and of a chunk of probes, about.
BLOCK_BYTES, PROBE_BYTES = 1 << 20, 4 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_CELL = np.uint64(0x9E3779B97F4A7C15)
_DART = np.uint64(0xD1B54A32D192ED03)
_LEVEL = np.uint64(0x8CB92BA72F3D8DD7)


@functools.lru_cache(maxsize=1)
def poisson_table() -> np.ndarray:
    """65,536 equally likely outcomes of a Poisson number of mean one."""
    steps = (np.arange(65536) + 0.5) / 65536
    chances = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
    return np.searchsorted(chances, steps).astype(np.uint8)


def throw(elements: np.ndarray, weights: np.ndarray | None, begin: int, end: int, k: int, best: np.ndarray) -> None:
    """Throw the darts of the time [begin, end) and keep the earliest for each coordinate.

    ``best`` holds keys: the unit of time in the top 24 bits, then 40 bits of the
    time within it; equal keys are equal darts.
    """
    times = np.arange(begin, end, dtype=np.uint64)
    if weights is None:
        base, floor, weight = elements, None, None
    else:
        cells = np.ceil(weights).astype(np.int64)
        base = np.repeat(elements, cells)
        weight = np.repeat(weights, cells)
        floor = np.arange(len(base)) - np.repeat(np.cumsum(cells) - cells, cells)
        base = mixed(base + floor.astype(np.uint64) * _LEVEL)
    cell = mixed((base[:, None] + times[None, :] * _CELL).ravel())
    number = poisson_table()[(cell >> np.uint64(48)).astype(np.int64)]
    which = np.repeat(np.arange(len(cell)), number)
    if len(which) == 0:
        return
    nth = np.arange(len(which)) - np.repeat(np.cumsum(number, dtype=np.int64) - number, number)
    dart = mixed(cell[which] + (nth + 1).astype(np.uint64) * _DART)
    # Of a dart's 64 bits the low ones choose the coordinate, the high ones the time.
    key = (times[which % len(times)] << np.uint64(40)) | (dart >> np.uint64(24))
    place = (dart & np.uint64(k - 1)).astype(np.int64)
    if weight is not None and (weight < floor + 1).any():  # whole weights fill their cells
        owner = which // len(times)
        height = floor[owner] + (mixed(dart ^ _LEVEL) >> np.uint64(11)) * 2.0**-53
        hit = height < weight[owner]
        key, place = key[hit], place[hit]
    np.minimum.at(best, place, key)


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """k keys of a set (weights None: all one) of hashed elements; a power of two."""
    best = np.full(k, _EMPTY, dtype=np.uint64)
    total = float(len(elements) if weights is None else weights.sum())
    if total <= 0:
        return best
    begin, end = 0, max(1, math.ceil((math.log(k) + 2) * k / total))
    while True:
        # In slices of time, so that a low total weight takes no more memory.
        step = max(1, 2_000_000 // max(1, len(elements)))
        for t in range(begin, end, step):
            throw(elements, weights, t, min(end, t + step), k, best)
        if not (best == _EMPTY).any() or end >= 1 << 23:
            return best
        begin, end = end, min(2 * end, 1 << 23)


def band_hashes(keys: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit hash for each band."""
    value = np.arange(1, bands + 1, dtype=np.uint64) * _CELL
    for row in keys.reshape(bands, rows).T:
        value = mixed(value ^ row)
    return value.view(np.int64)


def weighed(text: str, weights: str, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The distinct shingles of a text, sorted, and their weights: "one" or "count"."""
    if weights == "one":
        return np.unique(shingles(text, n)), None
    elements, counts = np.unique(shingles(text, n), return_counts=True)
    return elements, counts.astype(float)


def similarity(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None]) -> float:
    """Weighted Jaccard similarity of two sets; 0 if both are empty."""
    if a[1] is None or b[1] is None:
        common = len(np.intersect1d(a[0], b[0], assume_unique=True))
        union = len(a[0]) + len(b[0]) - common
        return common / union if union else 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0


def bucket_rows(nodes: DataFrame, weights: str = WEIGHTS, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node, text -> (bucket, node), a row for each band; texts without words have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, found = [], []
            for node, text in zip(frame["node"], frame["text"], strict=True):
                elements, own = weighed(text, weights, n)
                if len(elements):
                    kept.append(node)
                    found.append(band_hashes(signature(elements, own, bands * rows), bands, rows))
            yield pd.DataFrame({"node": kept, "buckets": found})

    return nodes.mapInPandas(run, "node long, buckets array<long>").select(F.explode("buckets").alias("bucket"), "node")


def expanded(elements: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """A multiset as a set: an element that occurs n times stands for n elements. The
    Jaccard similarity of such sets is the weighted one of the multisets."""
    if counts is None:
        return elements
    times = counts.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.unique(mixed(np.repeat(elements, times) + nth.astype(np.uint64) * _LEVEL))


def element_rows(nodes: DataFrame, weights: str = WEIGHTS, n: int = WORDS) -> DataFrame:
    """node, text -> (node, elements): the sets as packed sorted 64-bit numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "elements": [expanded(*weighed(text, weights, n)).tobytes() for text in frame["text"]]})

    return nodes.mapInPandas(run, "node long, elements binary")


def checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    known = pairs = written(pairs, "pairs")
    n = pairs.count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = [similarity((np.frombuffer(x, np.uint64), None), (np.frombuffer(y, np.uint64), None)) >= threshold - EDGE for x, y in zip(frame["ae"], frame["be"], strict=True)]
            yield frame.loc[near, ["a", "b"]]

    # A centre is in many pairs: each side's sets meet them by node and salt.
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("elements").alias(f"{side}e"))
        pairs = by_host(pairs, own, checkpointed(pairs_of(known, side), n), side, NEVER, 256)
    return pairs.select("a", "b", "ae", "be").mapInPandas(run, "a long, b long")


#: More bytes than any broadcast's bound.
NEVER = 1 << 62


def pairs_of(pairs: DataFrame, side: str) -> DataFrame:
    """How many pairs a node is in, of those in more than a few."""
    return pairs.groupBy(side).agg(F.count("*").alias("n")).where("n > 64")


def links_of_block(base: list[np.ndarray], base_labels: np.ndarray, probes: list[np.ndarray], probe_labels: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(probe, base) of near pairs with different labels, one for each probe and label.

    The base's sets as postings: what a probe shares with all of them is one count over
    the postings of its elements.
    """
    values = np.concatenate(base)
    order = np.argsort(values, kind="stable")
    owners = np.repeat(np.arange(len(base)), [len(x) for x in base])[order]
    known, begins = np.unique(values[order], return_index=True)
    ends = np.append(begins[1:], len(values))
    sizes = np.array([len(x) for x in base])
    found = []
    for i, probe in enumerate(probes):
        at = np.minimum(np.searchsorted(known, probe), len(known) - 1)
        at = at[known[at] == probe]
        lengths = ends[at] - begins[at]
        offsets = np.repeat(begins[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.bincount(owners[offsets], minlength=len(base))
        near = np.flatnonzero((common >= (threshold - EDGE) * (sizes + len(probe) - common)) & (base_labels != probe_labels[i]) & (common > 0))
        _, first = np.unique(base_labels[near], return_index=True)
        found += [(i, int(j)) for j in near[first]]
    return found


def block_links(held: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different classes within the buckets of bucket, node, label, main.

    ``main`` is the class with the most nodes of a bucket. Its bucket's other nodes are
    probes, held against all nodes of the bucket in blocks: a block has about
    BLOCK_BYTES of sets, a chunk of probes PROBE_BYTES, so a group's memory is bounded
    whatever the bucket's size, and no pair becomes a row unless it is a link.
    """
    rows = held.join(sets, "node").withColumn("weight", F.octet_length("elements") + 64)
    probe = F.col("label") != F.col("main")
    totals = rows.groupBy("bucket").agg(F.sum("weight").alias("all"), F.sum(F.when(probe, F.col("weight")).otherwise(0)).alias("other"), F.count("*").alias("n"))
    rows = met(rows, checkpointed(totals), ["bucket"], 32).select(
        "bucket", "node", "label", "elements", probe.alias("probe"),
        F.ceil(F.col("all") / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"), F.ceil(F.greatest("other", F.lit(1)) / F.lit(PROBE_BYTES)).cast("int").alias("chunks"),
    )
    own_block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    own_chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    at_base = F.transform(every(F.col("chunks")), lambda c: F.struct(own_block.alias("block"), c.alias("chunk"), F.lit(False).alias("asks")))
    at_probe = F.transform(every(F.col("blocks")), lambda b: F.struct(b.alias("block"), own_chunk.alias("chunk"), F.lit(True).alias("asks")))
    places = F.when(F.col("probe"), F.concat(at_base, at_probe)).otherwise(at_base)
    placed = rows.withColumn("place", F.explode(places)).select("bucket", "place.*", "node", "label", "elements")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        base, probes = frame[~asks], frame[asks]
        if not len(base) or not len(probes):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        read = lambda rows: [np.frombuffer(x, np.uint64) for x in rows["elements"]]
        found = links_of_block(read(base), base["label"].to_numpy(), read(probes), probes["label"].to_numpy(), threshold)
        first, second = base["node"].to_numpy(), probes["node"].to_numpy()
        return pd.DataFrame({"a": [second[i] for i, _ in found], "b": [first[j] for _, j in found]}, dtype="int64")

    return placed.groupBy("bucket", "block", "chunk").applyInPandas(run, "a long, b long")


def node_labels(nodes: DataFrame, threshold: float = SIMILARITY, weights: str = WEIGHTS, n: int = WORDS, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """node, text (distinct) -> (node, label) of the nodes that have a near-duplicate."""
    buckets = written(bucket_rows(nodes, weights, n, bands, rows), "buckets")
    # Buckets of one node tell nothing; sums come before the shuffle, so a bucket
    # that a third of all texts share is no hot task.
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count("*").alias("n")).where("centre < last").drop("last")
    n_buckets = buckets.count()
    shared = written(shared, "shared", n_buckets)
    n_members = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    members = written(met(buckets, shared, ["bucket"], 24).select("bucket", "node", "centre"), "members", n_buckets)
    touched = members.select("node").distinct()
    sets = written(element_rows(nodes.join(touched, "node", "left_semi"), weights, n), "sets")
    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(checked(pairs, sets, threshold))
    open_rows = members.select("bucket", "node")
    before = None
    for turn in range(rounds + 1):
        held = open_rows.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        unsettled = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
        unsettled = written(unsettled.select("bucket", "size", F.col("size").alias("n")), "unsettled", n_members)
        held = written(met(held, unsettled, ["bucket"], 24), "held", n_members)
        # Each bucket's class with the most nodes there, a node of it, and the pairs left.
        order = F.struct(F.xxhash64("bucket", "node", F.lit(turn)).alias("o"), F.col("node").alias("centre"))
        sizes = held.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.min(order).alias("m"), F.first("size").alias("size"))
        tops = sizes.groupBy("bucket").agg(F.max(F.struct("c", "m", "label")).alias("m"), (F.sum(F.col("c") * (F.col("size") - F.col("c"))) / 2).alias("pairs"), F.sum("c").alias("n"))
        tops = written(tops.select("bucket", F.col("m.m.centre").alias("centre"), F.col("m.label").alias("main"), "pairs", "n"), "tops", n_members)
        left = tops.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).first()["n"]
        if not left:
            return labels
        open_rows = held.select("bucket", "node")
        if turn == rounds or (before is not None and left > 0.7 * before):
            break  # centres don't settle any more
        before = left
        # The most likely to be near to the others: a node of the largest class there.
        pairs = met(held, tops, ["bucket"], 40).where("label <> main").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        labels = components(checked(pairs, sets, threshold), labels)
    held = met(held, tops, ["bucket"], 40).select("bucket", "node", "label", "main", "pairs")
    few = held.where(F.col("pairs") <= PAIRS)
    one = few.select("bucket", F.col("node").alias("a"), F.col("label").alias("la"))
    other = few.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = one.join(other, "bucket").where("la < lb").select("a", "b").distinct()
    links = checked(pairs, sets, threshold).unionByName(block_links(held.where(F.col("pairs") > PAIRS), sets, threshold))
    return components(links, labels)


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents with one of each class: the one with the smallest id.

    Of rows that share that id (repeated rows) one stays. Rows with null ids in a
    class without an id: one of each text stays.
    """
    found = classes(docs, threshold)
    keep, key = internal(docs, "__keep"), internal(docs, "__node")
    text = text_of(docs)
    node = F.coalesce(docs["doc_id"].cast("long"), -F.shiftrightunsigned(F.xxhash64(text), 2) - 1)
    kept = written(found.groupBy("label").agg(F.coalesce(F.min("doc_id"), F.min("node")).alias(key)).select(key).distinct(), "kept")
    rows = docs.withColumn(key, node).join(small(kept, kept.count(), 8), key, "left_semi")
    repeated = written(rows.groupBy(key).agg(F.count("*").alias(keep)).where(F.col(keep) > 1).select(key), "repeated")
    many = repeated.count()
    if many == 0:
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
    mark = internal(docs, "__repeated")
    flagged = rows.join(small(repeated.withColumn(mark, F.lit(True)), many, 9), key, "left")
    once = flagged.where(F.col(mark).isNull())
    first = flagged.where(F.col(mark)).dropDuplicates([key])
    return once.unionByName(first).select(*[F.col(f"`{c}`") for c in docs.columns])


def classes(docs: DataFrame, threshold: float = SIMILARITY, weights: str = WEIGHTS, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest id of its class), class_size;
    also the internal node (a negative one for a null id) and its class's label.

    Texts are near if the Jaccard similarity of their multisets of n-word shingles (of
    their sets, with ``weights="one"``) is at least the threshold; classes are the
    connected components. A text with fewer than n words is one shingle.
    Equal texts are one class, also empty ones (a null text is an empty one).
    ``doc_id`` identifies a document: texts that share an id share a class. A null
    id gets a class of its text's own: class_id null unless the class has an id.
    Repeated rows give repeated results. An empty table stays empty.
    """
    text = text_of(docs)
    # A null id's node is negative and follows from the text.
    own = F.coalesce(docs["doc_id"].cast("long"), -F.shiftrightunsigned(F.xxhash64(text), 2) - 1)
    rows_ = docs.select(docs["doc_id"].cast("long").alias("doc_id"), own.alias("node"), F.md5(text).alias("digest"), text.alias("text"))
    slim = written(rows_.select("doc_id", "node", "digest"), "ids")
    n_docs = slim.count()
    firsts = written(slim.groupBy("digest").agg(F.min("node").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "digests", n_docs)
    alone = written(firsts.select(F.col("first").alias("node")).distinct(), "firsts", n_docs)
    nodes = rows_.join(small(alone, alone.count(), 8), "node", "left_semi").select("node", "text")
    labels = node_labels(nodes, threshold, weights, n, bands, rows)
    # A row for each text, then its class's totals, then a row for each document.
    texts = firsts.join(labels.select(F.col("node").alias("first"), "label"), "first", "left")
    texts = written(texts.select("digest", "least", F.col("n").alias("copies"), F.coalesce("label", "first").alias("label")), "labelled", n_docs)
    totals = written(texts.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n")), "totals", n_docs)
    known = written(met(texts, totals, ["label"], 32).select("digest", "label", "class_id", "class_size", F.col("copies").alias("n")), "known", n_docs)
    return met(slim, known, ["digest"], 72).select("doc_id", "class_id", "class_size", "node", "label")


def op10_dart_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


OP10_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0),
sh AS (SELECT doc_id, ws[p:p + 4] AS s, count(*) AS c FROM pos GROUP BY doc_id, ws[p:p + 4]),
n AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
         UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
label AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM label
"""

QUERIES = {"op10_dart_dedup": op10_dart_dedup}
ORACLES = {"op10_dart_dedup": OP10_SQL}
