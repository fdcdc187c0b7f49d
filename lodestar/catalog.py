"""Registry of the engine's queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES: tuple[str, ...] = (
    "scans",
    "vectors",
    "lexical",
    "scoring",
    "graphs",
    "records",
    "functions_",
    "recalls",
    "directory",
)


def _registered() -> dict[str, tuple[Query, str | None]]:
    from importlib import import_module

    found: dict[str, tuple[Query, str | None]] = {}
    for module in _MODULES:
        for name, pair in import_module(f"lodestar.plans.{module}").REGISTERED.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql is not None}
