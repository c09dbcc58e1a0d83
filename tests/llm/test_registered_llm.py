"""The pN_ queries over whole small tables; those with SQL against DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from ravelin.llm import queries as Q


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for table in os.listdir(sf):
        c.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{table}'")
    df = entry.queries()[name](spark, sf)
    result = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(plain, df.select(*names).collect())) == Counter(map(plain, result.fetchall()))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, sf, name):
    rows = entry.queries()[name](spark, sf).collect()
    assert len(rows) == len(set(map(str, rows)))
    assert rows or name == "p7_found"
