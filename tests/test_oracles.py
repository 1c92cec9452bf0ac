"""Every query with SQL gives DuckDB's rows; those without give some."""

from __future__ import annotations

import math

import duckdb
import pytest

from lucidex.plans import queries, sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, sf, duck):
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in sql():
        assert rows
        return
    result = duck.sql(sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
