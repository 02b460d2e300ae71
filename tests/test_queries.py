"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from callshelf.plans.oracles import ORACLES
from callshelf.plans.queries import QUERIES
from check import compare, duck

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    problem = compare(spark, connection, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None, problem


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "cid", "code_cid", "code_name", "code_type", "is_test", "file_path", "tags",
    ]
    assert df.count() > 0
