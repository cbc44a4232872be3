"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from glyphgrid.plans import registry

D = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, expected = registry.queries()[name](spark, D).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0 and rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql(spark, name):
    """Those that SQL doesn't state: rows are there, and a second run gives the same. What they say is tested in test_operators."""
    first, second = (registry.queries()[name](spark, D).toPandas() for _ in range(2))
    assert len(first) > 0 and rows(first) == rows(second)
