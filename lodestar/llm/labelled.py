"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fold_of

_SCALE = 1 << 30


def bounded_labels(labels: DataFrame, column: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, label of the labelled rows outside the held-out fold: ``bound`` rows or so at most.

    Rows without an id or a label are left out. If there are more, a fixed hash of
    the id chooses; so the size of what is broadcast or gathered is known beforehand.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.where(fold_of(F.col("doc_id"), folds) != held_out)
    n = rows.count()
    if n > bound:
        share = int(_SCALE * bound / n)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_SCALE)) < share)
    return rows


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label: the labels (a bounded table) meet the texts where they are."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(labels), "doc_id")
