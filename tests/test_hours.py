"""Interval queries on events before the axis begins, against their SQL."""

import datetime as dt

import duckdb
import pytest

from axisflow.plans.catalog import ORACLES, QUERIES

BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hours"))
    minutes = {1: [-30, 90], 2: [-361, -330, 400], 3: [-2_000, -1_999], 4: [-9_000, -70, 6_100, 8_900], 5: [12_100], 6: [-1], 7: [3_000]}
    rows = [(u, BEGIN + dt.timedelta(minutes=m)) for u, times in minutes.items() for m in times]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["interval_dense", "interval_assign_ones", "interval_assign_other", "interval_serialize"])
def test_hours_before_the_axis(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, events).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
