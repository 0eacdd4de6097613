"""Every query with SQL gives what DuckDB gives on the same files."""

import os

import duckdb
import pytest

from disclosa.plans import extraction  # noqa: F401
from disclosa.plans.catalogue import QUERIES, SQL


def rows_of(rows, cols, names):
    show = lambda v: None if v is None else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(str(show(r[names.index(c)])) for c in cols) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], cols, df.columns) == rows_of(want.fetchall(), cols, list(want.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
