"""The folder that the whole cluster shares: cut lineage, committed tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local master, where one machine does all, gets a folder of its own if the
    setting is missing; a cluster must name one that all of it sees.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Rows of a narrow table that go to one file, where a table's rows are known to be few.
FILE_ROWS = 100_000


def fewer(df: DataFrame, rows: int | None) -> DataFrame:
    """The table in no more parts than its rows (known, or bounded) need. Fewer parts are
    fewer tasks of the stage that makes it: the rows are to be those that it reads, too."""
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows from the shared checkpoint folder, with the lineage cut."""
    ensure_checkpoints(df.sparkSession)
    return fewer(df, rows).checkpoint(eager=True)


_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there stays until ``swept``."""
    path = os.path.join(ensure_checkpoints(spark), f"{name}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def swept(spark: SparkSession) -> int:
    """Delete the tables that this driver's queries have written to the shared folder; to be
    called when their results have been read. Returns how many there were."""
    made, _MADE[:] = list(_MADE), []
    for path in made:
        removed(spark, path)
    return len(made)


def _path(spark: SparkSession, folder: str):
    """A path and its file system, whatever that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of the tables below a folder whose writing has ended well."""
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path) if status.isDirectory()]
    return sorted(n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder if it is there."""
    path, system = _path(spark, folder)
    system.delete(path, True)
