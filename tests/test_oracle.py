"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return list(x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == rows


def test_every_query_has_sql_or_is_known_to_have_none():
    without = {k for k in entry.queries() if k not in SQL}
    assert {k for k in without if not k.startswith("op") and k != "pipeline"} == set()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
