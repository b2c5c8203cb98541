"""Every core query that has SQL against DuckDB, on the smallest data; the rest must run."""

from __future__ import annotations

import math
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from tracelode.queries import registry  # noqa: E402

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, table):
    at = [list(columns).index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in table), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    return con


def test_sql_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())
