"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size`` times. The expected
copies are summed along the source's documents, one random offset a source is
added, and a document is taken once for each integer that its part of the sum
crosses. Along the order of size the errors of neighbours cancel, so a source's
words come within about two of its largest documents of the target.

The order in a source is (size, md5 of the id, id). Ranks come in two levels: a
window in each block of a source's documents, and the blocks' running counts. A
block is a size; where many documents share one size it is cut further by leading
digits of the md5, which keeps the order. So no task gets a whole source, and the
running counts see one row for each size only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed, internal, small, table, text_of, words_of


@dataclass(frozen=True)
class Mix:
    """What the sources share, in per cent of all sizes; weights repeat in order."""

    weights: tuple[int, ...] = (3, 1, 2)
    share_percent: int = 150
    max_copies: int = 2
    seed: str = "mix-1"


MIX = Mix()
#: A block of one size is cut if it has more documents than this and than 1/2000 of all.
BLOCK = 512
BLOCKS = 2000


def source_key(source: Column) -> Column:
    """A text that isn't null and sorts as the sources do, null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def targets(sizes: DataFrame, mix: Mix = MIX) -> DataFrame:
    """key, source_size -> also weight and target, one row a source.

    Water filling in closed form: in the order of limit to weight, a source is held
    at its limit if the words left, shared by the weights left, would exceed it.
    """
    by_key = Window.orderBy("key")
    weights = F.array(*[F.lit(w) for w in mix.weights])
    rows = sizes.withColumn("weight", F.get(weights, ((F.row_number().over(by_key) - 1) % len(mix.weights)).cast("int")))
    rows = rows.withColumn("limit", (F.col("source_size") * mix.max_copies).cast("double"))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(mix.share_percent / 100)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    held = F.col("level") >= F.col("ratio")
    # The first source that isn't held sets the level of all that aren't.
    rows = rows.withColumn("free_level", F.min(F.when(~held, F.struct("ratio", "key", "level"))).over(whole)["level"]).withColumn("held", held)
    target = F.when(F.col("held"), F.col("limit")).otherwise(F.col("free_level") * F.col("weight"))
    return rows.select("key", "source_size", "weight", target.cast("double").alias("target"))


def offset(key: Column, seed: str) -> Column:
    """A source's offset in [0, 1): 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, mix: Mix = MIX, out: str = "mix", text_column: str = "text", source_column: str = "source", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The documents with a struct column: size, source_size, target, copies.

    Size is the number of words, 0 for a null text. Null sources are one source, the
    last. A document of size 0 is taken as others are, which adds no words; where a
    source has no words its documents are taken 0 times. Repeated rows are separate
    documents; ties of id are ordered by a hash of the text. An empty table stays
    empty. ``keep`` names the columns that stay, all by default.
    """
    kept = docs.columns if keep is None else keep
    key, size, tie = (internal(docs, n) for n in ("__key", "__size", "__tie"))
    n, mark, rank, cut = (internal(docs, n) for n in ("__n", "__mark", "__rank", "__cut"))
    text = text_of(docs, text_column)
    rows = docs.select(
        *[docs[f"`{c}`"] for c in kept],
        source_key(docs[source_column]).alias(key),
        F.size(words_of(text)).cast("long").alias(size),
        F.struct(F.md5(F.coalesce(docs[id_column].cast("string"), F.lit(""))).alias("m"), docs[id_column].cast("string").alias("i"), F.xxhash64(text).alias("x")).alias(tie),
    )
    counts = checkpointed(rows.groupBy(key, size).agg(F.count("*").alias(n)))
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    block = max(BLOCK, total // BLOCKS)
    # At most BLOCKS sizes have more documents than that, however many there are.
    digits = F.ceil(F.log(16.0, F.col(n) / F.lit(float(block)))).cast("int")
    hot = counts.where(F.col(n) > block).select(F.col(key).alias("k"), F.col(size).alias("s"), digits.alias(cut))
    rows = rows.join(F.broadcast(hot), (rows[key] == F.col("k")) & (rows[size] == F.col("s")), "left").drop("k", "s")
    rows = rows.withColumn(mark, F.substring(F.col(tie)["m"], F.lit(1), F.coalesce(F.col(cut), F.lit(0)))).drop(cut)
    inside = Window.partitionBy(key, size, mark).orderBy(F.col(tie)["m"], F.col(tie)["i"], F.col(tie)["x"])
    rows = rows.withColumn(rank, F.row_number().over(inside).cast("long"))

    plain = counts.join(F.broadcast(hot), (counts[key] == F.col("k")) & (counts[size] == F.col("s")), "left_anti").select(key, size, F.lit("").alias(mark), n)
    parted = docs.select(source_key(docs[source_column]).alias(key), F.size(words_of(text)).cast("long").alias(size), F.md5(F.coalesce(docs[id_column].cast("string"), F.lit(""))).alias("m"))
    parted = parted.join(F.broadcast(hot), (parted[key] == F.col("k")) & (parted[size] == F.col("s"))).groupBy(key, size, F.substring(F.col("m"), F.lit(1), F.col(cut)).alias(mark)).agg(F.count("*").alias(n))
    blocks = plain.unionByName(parted) if hot.take(1) else plain
    running = Window.partitionBy(key).orderBy(size, mark).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(n).over(running), F.lit(0)))
    sources = targets(counts.groupBy(F.col(key).alias("key")).agg(F.sum(F.col(size) * F.col(n)).alias("source_size")), mix)
    blocks = blocks.join(sources, blocks[key] == sources["key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = checkpointed(blocks.select(F.col(key).alias("k"), F.col(size).alias("s"), F.col(mark).alias("d"), "before", "source_size", "target", rate.alias("rate"), offset(F.col("key"), mix.seed).alias("offset")))
    blocks = small(blocks, blocks.count(), 96)
    joined = rows.join(blocks, (rows[key] == F.col("k")) & (rows[size] == F.col("s")) & (rows[mark] == F.col("d")))
    place = F.col("before") + F.col(rank)
    copies = F.floor(F.col("offset") + F.col("rate") * place) - F.floor(F.col("offset") + F.col("rate") * (place - 1))
    result = F.struct(F.col(size).alias("size"), "source_size", "target", copies.cast("long").alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], result.alias(out))


def mixed(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The mix: each document as often as it is taken, with its own columns."""
    out = internal(docs, "__mix")
    rows = with_copies(docs, mix, out).where(F.col(out)["copies"] > 0)
    copy = internal(docs, "__copy")
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(out)["copies"])))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = F.col("mix")
    return with_copies(docs, keep=["doc_id"]).select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight, (2 * source_size)::DOUBLE AS lim FROM s),
r AS (SELECT *, lim / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(lim) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level < ratio),
t AS (SELECT l.key, source_size, CASE WHEN l.level >= ratio THEN lim ELSE f.level * weight END AS target,
             ('0x' || substr(md5('mix-1:' || l.key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, f),
k AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.key ORDER BY size, md5(doc_id::VARCHAR), doc_id::VARCHAR) AS place
      FROM d JOIN t ON d.key = t.key)
SELECT doc_id, size, source_size, target, ((floor(u + rate * place) - floor(u + rate * (place - 1)))::BIGINT * size)::BIGINT AS taken FROM k
"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": OP3_SQL}
