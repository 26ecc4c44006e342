"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as registered
from catalogue.oracle import ORACLE
from catalogue.queries import QUERIES
from tests.compare import connect, spark_rows, sql_rows


# Queries whose right answer has no rows.
EMPTY = {"sync_not_in_null_trap"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name not in EMPTY:
        assert rows
    expected_names, expected = sql_rows(con, ORACLE[name])
    assert names == expected_names
    assert rows == expected


def test_every_query_has_sql_and_is_registered():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(registered.queries()) and set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    counts = {row["op"]: row["n"] for row in registered.entry(spark).collect()}
    assert set(counts) == {"same", "update", "insert", "delete"}
