"""Registered queries: each runs on the smallest tables, and those with SQL match DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import folia.catalog as catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return ""
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    got = [tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = db.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert sorted(got) == sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
