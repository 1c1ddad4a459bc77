"""Hold a query's rows against those of its SQL on another engine."""

import os

import duckdb
import pandas as pd


def connection(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        source = f"{path}/**/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{source}'")
    return con


def cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))
    return str(v)


def rows(frame, columns):
    return sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


def assert_same(spark, sf, query, sql):
    want = connection(sf).sql(sql).df()
    got = query(spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
