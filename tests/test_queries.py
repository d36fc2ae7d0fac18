"""Every registered query runs, and those with SQL give what DuckDB gives on the same whole tables."""

from __future__ import annotations

import pytest
from compare import rows
from conftest import DATA

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).columns == ["market", "symbol", "timeframe", "slot_ms"]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQL)))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b))[:3], list((b - a))[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
