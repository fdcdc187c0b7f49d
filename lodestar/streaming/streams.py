"""Streams of events: windows, sessions, de-duplication, state.

State is bounded by watermarks where windows can close; what keeps state for a key
keeps a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.sources.lineage import committed, shared_folder


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Watermarks need instants: the time's digits as one in UTC, whatever the session's zone."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    timed = rows.withColumn("at", F.timestamp_micros(micros))
    return timed.withWatermark("at", late) if rows.isStreaming else timed


def _start() -> Column:
    """The beginning of the window w, without a zone again."""
    return F.expr("timestampadd(MICROSECOND, unix_micros(w.start), timestamp_ntz'1970-01-01 00:00:00')").alias("start")


def tumbling(rows: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind of event in fixed windows."""
    found = _timed(rows, late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(_start(), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """A user's sessions: a gap ends one."""
    found = _timed(rows, late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", _start(), "n")


def deduplicated(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; its state goes with the watermark."""
    timed = _timed(rows, late)
    once = timed.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else timed.dropDuplicates(keys)
    return once.select("event_id", "user_id", "event_type")


def habituation(rows: DataFrame, rate: float = 0.2) -> DataFrame:
    """user_id, n, penalty: how often a user was seen, kept as state."""

    def seen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        n += sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "penalty": [round(1 / (1 + (n - 1) * rate), 6)]})

    return rows.groupBy("user_id").applyInPandasWithState(seen, "user_id long, n long, penalty double", "n long", "update", GroupStateTimeout.NoTimeout)


def welford(rows: DataFrame, warm_up: int = 20) -> DataFrame:
    """event_type, n, mean, deviation: running moments, kept as state."""

    def moments(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for frame in frames:
            for x in frame["value"].dropna():
                n += 1
                gap = x - mean
                mean += gap / n
                m2 += gap * (x - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [mean], "deviation": [(m2 / n) ** 0.5 if n >= warm_up else 0.0]})

    return rows.groupBy("event_type").applyInPandasWithState(moments, "event_type string, n long, mean double, deviation double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, rows: DataFrame, mode: str, keys: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """What a stream has given when all that is there has been read.

    Each batch is a table in the shared folder (one that runs again writes the same
    one), and nothing comes to the driver. "append" gives all batches, "complete" the
    last one, "update" the last row of each of the ``keys``. A ``folder`` that is given
    again goes on where the stream ended.
    """
    base = folder or shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = sorted(int(n) for n in committed(spark, f"{base}/out"))
    if not numbers:
        return spark.createDataFrame([], rows.schema)
    if mode == "complete":
        return spark.read.schema(rows.schema).parquet(f"{base}/out/{numbers[-1]}")
    if mode == "append":
        return spark.read.schema(rows.schema).parquet(*[f"{base}/out/{n}" for n in numbers])
    every = None
    for n in numbers:
        own = spark.read.schema(rows.schema).parquet(f"{base}/out/{n}").withColumn("_batch", F.lit(n))
        every = own if every is None else every.unionByName(own)
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "_batch").alias("m"))
    return last.select(*[c if c in keys else F.col(f"m.{c}").alias(c) for c in rows.columns])


#: So many batches' changes are folded into one table.
FOLDED = 16


def newest(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The last event of each user from the newest folded table and the changes since."""
    numbers = [n for n in sorted(map(int, committed(spark, base))) if before is None or n < before]
    start = max([n for n in numbers if n % FOLDED == FOLDED - 1], default=0)
    paths = [f"{base}/{n}" for n in numbers if n >= start]
    if not paths:
        return None
    return spark.read.schema("user_id long, event_id long").parquet(*paths).groupBy("user_id").agg(F.max("event_id").alias("event_id"))


def upserted(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """The last event of each user, kept up to date by each batch of a stream.

    A batch writes its own changes, every FOLDED-th the whole state. All that a batch
    builds on is found in the folder, so a driver that starts again goes on from there,
    and a batch that runs again writes the same table.
    """
    base = f"{folder}/state"

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        old = newest(batch.sparkSession, base, number) if number % FOLDED == FOLDED - 1 else None
        if old is not None:
            new = old.unionByName(new).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        new.write.mode("overwrite").parquet(f"{base}/{number}")

    query = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    found = newest(spark, base)
    return spark.createDataFrame([], "user_id long, event_id long") if found is None else found


def last_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user of the events."""
    return upserted(spark, events(spark, sf_dir), shared_folder(spark, "last"))
