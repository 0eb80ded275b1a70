"""Every registered query against its SQL."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    state, rows, _, note = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert state == "ok", note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, con, name):
    _, rows, _, _ = compare(spark, con, name, QUERIES[name], None, SF)
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
