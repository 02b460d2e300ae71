"""Registered queries of the operators: against their SQL, and the pipeline's stages."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from callshelf.llm import near_dedup
from callshelf.llm.queries import ORACLES, QUERIES
from callshelf.session import stage
from check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    registered = contract.queries()
    assert QUERIES.items() <= registered.items()
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert registered["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(spark, duck(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        given = docs
        docs = stage(function(spark, given, SF_DIR), "test-stage")
        assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in given.collect()}
        assert (len(ids) == given.count()) == (name == "personal data")
        if name == "near duplicates":
            left = near_dedup.near_duplicates(docs)
            assert left.where("NOT kept").count() == 0
    private = r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{16}\b"
    for row in docs.collect():
        for value in re.findall(private, before[row["doc_id"]]):
            assert value not in row["text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
