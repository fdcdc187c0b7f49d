"""Write paths: ingestion, connector sink, bundles, a vector store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.functions import vectors as v
from lodestar.operators import changes, chunking
from lodestar.sources.journal import Journal
from lodestar.sources.lineage import shared_folder


def ingested(docs: DataFrame, embed: Callable[[Column], Column], chunker: str = "markdown") -> DataFrame:
    """id, text -> id, chunk, text, digest, vector: chunked and embedded, a map over rows."""
    rows = chunking.chunked(docs, chunker)
    return rows.select("id", "chunk", "text", F.sha2("text", 256).alias("digest"), embed(F.col("text")).alias("vector"))


def failures(rows: DataFrame) -> DataFrame:
    """Chunks without a vector: what a partly failed ingestion left out."""
    return rows.where(F.col("vector").isNull()).select("id", "chunk")


def connected(docs: DataFrame, stored: DataFrame | None, chunker: str = "sentence") -> DataFrame:
    """A connector's rows scrubbed, chunked, and without what is stored unchanged."""
    clean = docs.select("id", t.scrubbed(F.coalesce("text", F.lit(""))).alias("text"))
    rows = chunking.chunked(clean, chunker).select(F.col("id").alias("doc_id"), "chunk", "text")
    fresh = rows if stored is None else changes.unchanged_skipped(stored, rows)
    return fresh.select(F.col("doc_id").alias("id"), "chunk", "text")


def export_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables and a manifest of their rows and checksums; returns the manifest.

    A checksum sums hashes of rows, so it doesn't depend on their order.
    """
    manifest = None
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
        own = checksum(table.sparkSession.read.parquet(f"{path}/{name}"), name)
        manifest = own if manifest is None else manifest.unionByName(own)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def checksum(table: DataFrame, name: str) -> DataFrame:
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(table.columns)])
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")


def import_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle, each held against the manifest."""
    found = {}
    for entry in spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest").collect():
        table = spark.read.parquet(f"{path}/{entry['name']}")
        own = checksum(table, entry["name"]).first()
        if (own["rows"], own["checksum"]) != (entry["rows"], entry["checksum"]):
            raise ValueError(f"table {entry['name']} doesn't fit the manifest")
        found[entry["name"]] = table
    return found


def bundle_round_trip(table: DataFrame, name: str) -> DataFrame:
    """A table written as a bundle and read back."""
    path = shared_folder(table.sparkSession, "bundle")
    export_bundle({name: table}, path)
    return import_bundle(table.sparkSession, path)[name]


class VectorStore:
    """add, delete and search over a journal of id, text, metadata, vector.

    add and delete append what changes; compact folds it. Opening the folder again finds
    the newest state.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column]):
        self.spark, self.embed = spark, embed
        self.journal = Journal(spark, path, "id long, text string, metadata map<string,string>, vector array<float>")

    def rows(self) -> DataFrame:
        return self.journal.rows()

    def add(self, docs: DataFrame) -> None:
        """Add id, text, metadata; an id that is there is replaced."""
        self.journal.put(docs.select("id", "text", "metadata", self.embed(F.col("text")).alias("vector")))

    def delete(self, ids: list[int]) -> None:
        self.journal.drop(self.spark.createDataFrame([(i,) for i in ids], "id long"))

    def compact(self) -> None:
        self.journal.compact()

    def search(self, query: str, k: int = 4, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
        """id, text, score of the nearest texts above the threshold that pass the filter."""
        rows = self.rows() if where is None else self.rows().where(where)
        one = self.spark.createDataFrame([(query,)], "q string").select(self.embed(F.col("q")).alias("asked"))
        scored = rows.crossJoin(F.broadcast(one))  # one row: no product
        score = v.cosine(v.as_doubles(F.col("vector")), v.as_doubles(F.col("asked")))
        return scored.select("id", "text", F.round(score, 6).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k)
