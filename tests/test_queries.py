"""Every query with SQL against DuckDB, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    ok, message = compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
