"""Training-data operators; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLES.
MODULES = (
    "factorization_toxicity",
    "quality_rules",
    "mixing",
    "token_counts",
    "wavelet_shards",
    "fourier_quality",
    "multiset_hash",
    "page_text",
    "bpe_codec",
    "dart_dedup",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"lodestar.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"lodestar.llm.{m}").ORACLES.items()}
