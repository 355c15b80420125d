"""Registered queries against DuckDB, and the driver's contract."""

import pytest

import __spark_entry__ as E
from patchloom.plans import queries
from tests.conftest import rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, duck, name):
    cols, expected = sql_rows(duck, queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    assert rows(got) == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert E.entry(spark).count() == 120
    assert set(E.oracle_sql()) <= set(E.queries())
