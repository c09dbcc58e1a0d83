"""Registered queries against DuckDB at the smallest scale, as multisets of rows."""

import collections
import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ravelin.plans import catalogue


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(sf)):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = collections.Counter(plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == collections.Counter(plain(tuple(r[i] for i in at)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "filename", "score", "rrf"]


def test_scan_is_pruned(spark, sf):
    plan = catalogue.vector_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,embedding:array<float>>" in plan
