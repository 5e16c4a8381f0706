"""Every registered query on the smallest tables, next to its SQL."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_given_for_known_queries_only():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name not in SQL:
        assert QUERIES[name](spark, sf).count() > 0
    else:
        assert compare(spark, con, QUERIES[name], SQL[name], sf).startswith("ok")
