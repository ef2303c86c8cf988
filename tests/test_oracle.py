"""Every query of the core with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from textloom.catalog import ORACLE, QUERIES
from textloom.session import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return "NULL" if v != v else f"{v:.9g}"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    return "NULL" if v is None or v is pd.NA or v is pd.NaT else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    assert df.count() >= 0
