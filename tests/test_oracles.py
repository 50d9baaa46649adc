"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from factloom.workloads import load
from tests.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(load().QUERIES), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name]), []) is None


def test_every_query_is_compared():
    assert not set(QUERIES) - set(ORACLES)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_compare_sees_differences(spark, duck):
    df = spark.createDataFrame([(1, "a")], "x BIGINT, y STRING")
    assert compare(df, duck.sql("SELECT CAST(1 AS BIGINT) AS x, 'b' AS y"), []) is not None
    assert compare(df, duck.sql("SELECT CAST(1 AS BIGINT) AS x, 'a' AS y"), []) is None
