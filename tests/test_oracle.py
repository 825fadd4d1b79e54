"""Every registered query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connection

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
