"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import check, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Rows these queries look for exist only at larger scales.
MAY_BE_EMPTY = {"summary_of_window", "volume_alarms"}


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, duck, tiny, name):
    note = check(spark, duck, tiny, QUERIES[name], SQL[name])
    assert note is None or (name in MAY_BE_EMPTY and note == "no rows on either side"), note


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_has_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).limit(1).collect()


def test_entry(spark):
    assert entry.entry(spark).limit(1).collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
