"""Registered queries run, with an oracle where there is one."""

from __future__ import annotations

import glob
import math
import os

import pytest

from lodestar import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.queries()) if os.path.isdir(FOLDER) else []


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def connected(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet') or [path]!r})")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    compare(spark, duck, FOLDER, name)


def test_queries_that_find_little_in_little_data(spark):
    """At the smallest size these find no pair; here they do."""
    folder = "/root/testdata/sf0.01"
    duck = connected(folder)
    for name in ("semantic_dedup", "proactive_interference", "entity_vector_resolution", "near_duplicate_vectors", "recall_trace"):
        assert compare(spark, duck, folder, name)


def compare(spark, duck, folder, name):
    found = catalog.queries()[name](spark, folder)
    rows = found.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return rows
    relation = duck.sql(sql)
    columns = list(relation.columns)
    assert sorted(columns) == sorted(found.columns)
    want = [tuple(map(plain, r)) for r in relation.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return rows


def test_names_and_oracles_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", ["ivf_pq_search", "spectrum_search"])
def test_recall_of_index_queries(spark, name, folder):
    exact = {(r["query_id"], r["id"]) for r in catalog.queries()["top_k_l2"](spark, folder).collect()}
    found = catalog.queries()[name](spark, folder).collect()
    recall = len(exact & {(r["query_id"], r["id"]) for r in found}) / len(exact)
    print(name, folder, round(recall, 3))
    assert recall >= 0.9
