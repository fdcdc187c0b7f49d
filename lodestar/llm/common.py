"""What the training-data operators share: words, folds, shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import let
from lodestar.sources.lineage import checkpointed, fewer, shared_folder

#: A word, as a Java (and RE2) pattern.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["by_host", "checkpointed", "fold_of", "internal", "let", "met", "shared_path", "small", "table", "text_of", "words_of", "written"]

#: The largest table, in bytes, that an operator broadcasts.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return shared_folder(spark, f"lodestar-{name}")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than a checkpoint."""
    path = shared_path(df.sparkSession, name)
    fewer(df, rows).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a table for broadcast if its counted size is below the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def met(rows: DataFrame, found: DataFrame, keys: list[str], row_bytes: int) -> DataFrame:
    """Inner join of rows with a table of one row a key and ``n``, the rows that the key has.

    All of ``found`` is broadcast if that is small; else only the hot keys are, those
    with a thousandth of all rows or more (so a thousand at most), and the others
    meet by a shuffle, in which no key has more rows than that.
    """
    size = found.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if size["k"] * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found.drop("n")), keys)
    bound = F.lit(max(1, size["n"] // 1000))
    hot, cold = found.where(F.col("n") >= bound).drop("n"), found.where(F.col("n") < bound).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


#: Rows of one host that go to one task where a table is dealt by host.
HOST_ROWS = 20_000


def by_host(rows: DataFrame, sites: DataFrame, hosts: DataFrame, key: str, n_bytes: int, least: int | None = None) -> DataFrame:
    """Left join of rows with a table of one row a host.

    Broadcast if that table's size (as counted) is below the bound. Else both are
    dealt by host and salt; ``hosts`` (key, n) tells how many salts a host has, and
    only hosts with more than one are broadcast: few, as each has ``least`` rows
    (HOST_ROWS) or more and a thousandth of all.
    """
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sites), key, "left")
    total = hosts.agg(F.sum("n").alias("n")).first()["n"] or 0
    each = max(HOST_ROWS if least is None else least, total // 1000)
    salt, salts = internal(rows, "__salt"), internal(rows, "__salts")
    hot = F.broadcast(hosts.where(F.col("n") > each).select(key, F.ceil(F.col("n") / F.lit(each)).cast("int").alias(salts)))
    n = F.coalesce(F.col(salts), F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]), n))
    spread = sites.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))).drop(salts)
    return dealt.drop(salts).join(spread, [key, salt], "left").drop(salt)


def internal(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
