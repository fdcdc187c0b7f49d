"""A table as a snapshot and the changes since, in a folder that all executors see.

A write appends a numbered table of changed rows only; the state is the newest change
of each key over the snapshot. A table counts once it is committed, so a write that
fails leaves nothing behind, and opening the folder again finds the newest state. One
writer at a time: a second one fails on the number that the first has taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.lineage import committed, removed

_DROPPED = "_dropped"


class Journal:
    """Rows by key: put, drop, replace, compact."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "id"):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n[len(kind) :]) for n in committed(self.spark, self.folder) if n.startswith(kind))

    def version(self) -> int:
        """The number of the newest committed write, 0 for none."""
        return max([0, *self._numbers("base-"), *self._numbers("change-")])

    def changes(self) -> DataFrame | None:
        """The newest change of each key since the snapshot, or None."""
        base = max([0, *self._numbers("base-")])
        later = [n for n in self._numbers("change-") if n > base]
        if not later:
            return None
        rows = None
        for n in later:
            own = self.spark.read.schema(f"{self.schema}, {_DROPPED} boolean").parquet(f"{self.folder}/change-{n}").withColumn("_n", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
        newest = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*self.columns, _DROPPED), F.col("_n")).alias("m"))
        return newest.select(F.col("_key").alias(self.key), *[F.col(f"m.{c}").alias(c) for c in self.columns if c != self.key], F.col(f"m.{_DROPPED}").alias(_DROPPED))

    def rows(self) -> DataFrame:
        """The state."""
        base = max([0, *self._numbers("base-")])
        state = self.spark.read.schema(self.schema).parquet(f"{self.folder}/base-{base}") if base else None
        newest = self.changes()
        if newest is not None:
            put = newest.where(~F.col(_DROPPED)).select(*self.columns)
            state = put if state is None else state.join(newest.select(self.key), self.key, "left_anti").select(*self.columns).unionByName(put)
        return self.spark.createDataFrame([], self.schema) if state is None else state

    def _write(self, rows: DataFrame, kind: str) -> None:
        path = f"{self.folder}/{kind}{self.version() + 1}"
        if path.rsplit("/", 1)[1] not in committed(self.spark, self.folder):
            removed(self.spark, path)  # what a failed write has left
        rows.write.parquet(path)

    def put(self, rows: DataFrame) -> None:
        """Add rows, or replace those of the same key."""
        self._write(rows.select(*self.columns, F.lit(False).alias(_DROPPED)), "change-")

    def drop(self, keys: DataFrame) -> None:
        """Take the rows of these keys out."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema if f.name != self.key]
        self._write(keys.select(self.key, *empty).select(*self.columns, F.lit(True).alias(_DROPPED)), "change-")

    def replace(self, rows: DataFrame) -> None:
        """A new snapshot; what is older is deleted once it is committed."""
        before = committed(self.spark, self.folder)
        self._write(rows.select(*self.columns), "base-")
        for name in before:
            removed(self.spark, f"{self.folder}/{name}")

    def compact(self) -> None:
        """The state as a snapshot without changes."""
        self.replace(self.rows())
