"""Stored partials against the readings that they stand for."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline.operators import partials as P


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.RandomState(3)
    n = 6000
    return pd.DataFrame({"sensor_id": np.where(rng.rand(n) < 0.4, 0, rng.randint(0, 6, n)),
                         "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.randint(0, 91 * 86400, n), unit="s"),
                         "pm25": np.where(rng.rand(n) < 0.05, np.nan, 1000 + rng.gamma(2, 15, n)), "station": rng.randint(0, 900, n)})


def months(spark, pdf, *wanted):
    part = pdf[pdf["datetime"].dt.month.isin(wanted)]
    df = spark.createDataFrame(part)
    return df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def test_any_period_comes_from_the_partials(spark, pdf, tmp_path):
    path = str(tmp_path / "partials")
    P.store_partials(months(spark, pdf, 1, 2, 3), path, distinct=["station"])
    first, last = dt.date(2024, 1, 20), dt.date(2024, 3, 7)
    inside = pdf[(pdf["datetime"].dt.date >= first) & (pdf["datetime"].dt.date <= last)].dropna()
    probs = {f"p{int(100 * p)}": p for p in (0.05, 0.5, 0.95)}
    for keys in ([], ["sensor_id"]):
        got = P.rolled_up(P.read_partials(spark, path, first, last), keys, probs, ["station"]).collect()
        groups = inside.groupby("sensor_id") if keys else [(None, inside)]
        want = {k: g for k, g in groups}
        assert len(got) == len(want)
        for r in got:
            mine = want[r.sensor_id if keys else None]
            v = np.sort(mine["pm25"].to_numpy())
            assert (r["count"], r["min"], r["max"]) == (len(v), v[0], v[-1])
            assert r["mean"] == pytest.approx(v.mean(), rel=1e-12) and r["std"] == pytest.approx(v.std(ddof=1), rel=1e-9)
            assert r["days"] == mine["datetime"].dt.date.nunique()
            for name, p in probs.items():
                assert abs(np.searchsorted(v, r[name]) / len(v) - p) < 0.0165 + 1 / len(v)
            assert abs(r["distinct_station"] / mine["station"].nunique() - 1) < 0.05


def test_a_new_month_adds_partitions_only(spark, pdf, tmp_path):
    path = str(tmp_path / "partials")

    def files():
        return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    P.store_partials(months(spark, pdf, 1, 2), path)
    before = files()
    P.store_partials(months(spark, pdf, 3), path)
    after = files()
    assert before.items() <= after.items() and all("month=2024-03" in f for f in set(after) - set(before))
    assert spark.read.parquet(path).agg(F.sum("n")).first()[0] == pdf["pm25"].notna().sum()
    P.store_partials(months(spark, pdf, 2), path)  # again: replaced, not added
    assert spark.read.parquet(path).agg(F.sum("n")).first()[0] == pdf["pm25"].notna().sum()
    plan = P.read_partials(spark, path, dt.date(2024, 3, 1), dt.date(2024, 3, 5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]


def test_partials_of_nothing(spark, pdf):
    df = months(spark, pdf, 1).where("pm25 < 0")
    row = P.rolled_up(P.daily_partials(df)).first()
    assert row["count"] is None and row["mean"] is None
    assert P.rolled_up(P.daily_partials(df), ["sensor_id"]).count() == 0
