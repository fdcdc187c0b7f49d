"""The pipeline's stages, and the registered queries."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from lodestar.llm import bpe_codec
from tests.llm.conftest import make_text


@pytest.fixture(scope="module")
def folder(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    messy.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, messy, folder, tmp_path):
    docs = messy
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            assert docs.count() > 0
    rows = out.collect()
    want = bpe_codec.digests(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, rows))
    ids = {r["doc_id"] for r in rows}
    assert 300 not in ids and 302 not in ids and 303 not in ids  # too few words
    assert len([i for i in ids if i is not None and 200 <= i < 206]) <= 1  # copies


def test_stages_of_empty(spark, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert names["pipeline"].__wrapped__ is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert make_text(1)
