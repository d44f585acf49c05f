"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from gristmill.plans import catalogue
from gristmill.tables import TABLES


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else format(value, ".12g")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "NULL" if value is None else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(normal(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 5


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["filter_eq"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan
    assert "o_orderdate" not in plan
