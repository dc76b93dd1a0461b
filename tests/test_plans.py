"""The shape of the physical plans that matters at scale."""

import pytest

from hazeline.plans.registry import QUERIES
from hazeline.sources import tables as S

SF = "/root/testdata/sf0.001"
LAZY = [n for n in QUERIES if not n.startswith(("stream_", "rf_", "gbt_", "sensor_forest", "sensor_boosted"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_no_python(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize("name", LAZY)
def test_no_unbounded_collection(spark, name):
    """Arrays are collected only for the 24 history readings of a forecast."""
    text = plan(spark, name)
    assert "collect_set" not in text
    assert ("collect_list" in text) == name.startswith("forecast")
    # the built-in exact percentile buffers every distinct value of a group
    assert "percentile(" not in text
    # a frame from the current row to the end is re-evaluated for every row
    assert "currentrow$(), unboundedfollowing$()" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(spark, "daily_sensor_stats")
    assert "GreaterThanOrEqual(value,0.0), LessThan(value,1000.0)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_readings_are_reduced_before_the_metadata_join(spark):
    """The scan of readings feeds a partial aggregate, not a join."""
    for name in ("daily_sensor_stats", "district_top10", "station_mean", "health_summary_sensors"):
        lines = plan(spark, name).splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "value" in line)
        above = " ".join(lines[max(0, at - 4):at])
        assert "HashAggregate" in above and "Join" not in above, name


def test_top_n_is_cut_before_the_shuffle(spark):
    for name in ("latest_24_per_sensor", "first_5_per_type", "forecast_24", "daily_mean_last_days"):
        assert "WindowGroupLimit" in plan(spark, name), name
    text = plan(spark, "latest_24_per_sensor")
    assert text.index("Exchange hashpartitioning") < text.index("Partial")


def test_snapshot_time_is_pushed_into_the_scan(spark):
    assert "EqualTo(ts,ScalarSubquery" in plan(spark, "latest_snapshot_rows")


def test_series_windows_are_split_by_bucket(spark):
    """Windows over readings partition by sensor and bucket; windows by sensor alone see one row per bucket."""
    for name in ("fill_time", "fill_linear", "fill_ffill", "rolling_features"):
        for line in plan(spark, name).splitlines():
            if "Window [" in line and ("_us" in line or "_pos" in line):
                assert "_bucket" in line.split("], [")[1], (name, line)


@pytest.mark.parametrize("name", [n for n in LAZY if n.endswith("_whole_table")])
def test_no_window_spans_a_whole_table(spark, name):
    """Windows over boundaries lie within a bucket or a block of buckets; only blocks of blocks are scanned together."""
    for line in plan(spark, name).splitlines():
        if "Window [" in line and "_bucket" in line:
            parts = line.split("], [")[1]
            assert "_bucket" in parts or "_bucket__" in line, line


def test_position_fill_moves_whole_rows_once(spark):
    """The plan that returns the rows reads them once; what the buckets need from outside is found before."""
    df = S.sparse_measurements(spark, SF)
    from hazeline.operators.series import fill_gaps
    text = plan_of(fill_gaps(df, "pm25", "datetime", order=["event_id"], method="ffill"))
    # boundaries come from a written table of one row per bucket
    assert sum("FileScan parquet" in line and "events.parquet" in line for line in text.splitlines()) == 1
