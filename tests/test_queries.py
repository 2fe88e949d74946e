"""Every query that SQL can express, against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from axisflow.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def table(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        pd.testing.assert_frame_equal(table(got), table(duck.execute(ORACLES[name]).df()), check_dtype=False)
