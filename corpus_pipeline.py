"""The corpus pipeline: rules, quality, near-dedup, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with
the columns of its input; each is written as Parquet and read again for the next.
Every stage handles null ids, texts and sources, repeated rows, empty tables and
further columns as the operator that it calls says in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe_codec, dart_dedup, fourier_quality, mixing, quality_rules
from lodestar.llm.common import shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by the line rule."""
    return quality_rules.filtered(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learnt from the labels of these."""
    return fourier_quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return dart_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return bpe_codec.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can't express the classifier; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
