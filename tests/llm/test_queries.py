"""Registered corpus queries against DuckDB, and the pipeline against the parts it is made of."""

import os

import pytest

import corpus_pipeline
from checks.compare import check, connect
from netloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = check(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_every_operator_has_a_query():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in QUERIES}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    for r in docs.collect():  # lines only ever go, in order
        rest = iter(texts[r.doc_id].split("\n"))
        assert all(line in rest for line in r.text.split("\n")) and r.n_chars == len(r.text)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in out)
