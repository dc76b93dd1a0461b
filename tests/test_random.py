"""Random series against pandas and NumPy, with hot sensors, small buckets and equal times."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hazeline.functions.risk import risk_band
from hazeline.operators import distribution as D
from hazeline.operators.latest import latest_n, latest_per_sensor
from hazeline.operators.quantiles import quantiles
from hazeline.operators import series
from hazeline.operators.series import fill_gaps, rolling_means

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def readings(seed, n=1500, sensors=12):
    """A third of the rows belongs to sensor 0; gaps come in runs; one sensor has no value at all."""
    rng = np.random.default_rng(seed)
    sensor = np.where(rng.random(n) < 0.33, 0, rng.integers(1, sensors, n))
    minute = np.sort(rng.choice(60 * 24 * 9, n, replace=False))
    value = np.round(rng.gamma(2, 20, n), 2)
    for start in rng.integers(0, n, 40):
        value[start:start + rng.integers(1, 60)] = np.nan
    value[sensor == sensors - 1] = np.nan
    return pd.DataFrame({"i": np.arange(n), "sensor_id": sensor,
                         "date": pd.Timestamp("2024-12-28") + pd.to_timedelta(minute, unit="min"), "pm25": value})


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("pm25", F.when(~F.isnan("pm25"), F.col("pm25")))


def pandas_fill(group, method, limit):
    s = group.set_index("date")["pm25"]
    if method == "interpolate_time":
        s = s.interpolate("time")
    elif method == "interpolate_linear":
        s = s.interpolate("linear", limit=limit)
    else:
        s = getattr(s, method)(limit=limit)
    return pd.Series(s.to_numpy(), index=group["i"])


@pytest.mark.parametrize("bucket_hours", [1, 24, 24 * 400])
@pytest.mark.parametrize("method", ["interpolate_time", "interpolate_linear", "ffill", "bfill"])
@pytest.mark.parametrize("keys", [("sensor_id",), ()])
def test_fill_equals_pandas(spark, method, bucket_hours, keys):
    pdf = readings(bucket_hours)
    # with 400 days per bucket nearly everything is cut into slices
    got = fill_gaps(to_spark(spark, pdf), keys=keys, order=["i"], method=method, limit=5, bucket_hours=bucket_hours,
                    max_bucket_rows=50 if bucket_hours > 24 else None)
    got = got.select("i", "pm25").toPandas().set_index("i")["pm25"].sort_index()
    if keys:
        parts = [pandas_fill(g, method, 5) for _, g in pdf.groupby("sensor_id")]
        expected = pd.concat(parts).sort_index()
    else:
        expected = pandas_fill(pdf, method, 5)
    np.testing.assert_allclose(got.to_numpy(float), expected.to_numpy(float), rtol=1e-9)


@pytest.mark.parametrize("bucket_hours", [2, 24, 24 * 400])
def test_rolling_equals_pandas(spark, bucket_hours):
    pdf = readings(5).dropna()
    got = rolling_means(to_spark(spark, pdf), (3, 6), ts="date", bucket_hours=bucket_hours,
                        slot_minutes=5 if bucket_hours == 24 else 60)
    assert got.count() == len(pdf)
    got = got.toPandas().set_index("i").sort_index()
    for h in (3, 6):
        parts = [pd.Series(g.set_index("date")["pm25"].rolling(f"{h}h", closed="left").mean().to_numpy(), index=g["i"])
                 for _, g in pdf.groupby("sensor_id")]
        np.testing.assert_allclose(got[f"pm25_mean_{h}h"].to_numpy(float), pd.concat(parts).sort_index().to_numpy(float))


def test_rolling_keeps_rows_without_time(spark):
    df = spark.createDataFrame([(1, None, 5.0), (1, None, 6.0)], "sensor_id int, datetime timestamp, pm25 double")
    assert [r["pm25_mean_3h"] for r in rolling_means(df).collect()] == [None, None]
    pdf = readings(6, 400)
    some = to_spark(spark, pdf).withColumn("date", F.when(F.col("i") % 9 > 0, F.col("date")))
    narrow = rolling_means(some, ts="date", slot_minutes=1)
    wide = rolling_means(some, ts="date", slot_minutes=60, bucket_hours=1)
    def means(df):
        return df.toPandas().set_index("i").sort_index()[["pm25_mean_3h", "pm25_mean_6h"]].to_numpy(float)
    np.testing.assert_allclose(means(narrow), means(wide), rtol=1e-9)
    assert narrow.columns == wide.columns == [*some.columns, "pm25_mean_3h", "pm25_mean_6h"]


def test_rolling_forgets_a_spike_and_ignores_nan(spark):
    rows = [(1, f"2025-01-{1 + i // 144:02d} {i // 6 % 24:02d}:{i % 6 * 10:02d}:00", 0.1) for i in range(300)]
    rows[0] = (*rows[0][:2], 1e17)
    rows[100] = (*rows[100][:2], float("nan"))
    df = spark.createDataFrame(rows, "sensor_id int, t string, pm25 double").select(
        "sensor_id", F.to_timestamp("t").alias("datetime"), "pm25")
    for bucket_hours in (1, 24, 2400):
        got = rolling_means(df, bucket_hours=bucket_hours).orderBy("datetime").collect()
        assert all(abs(r["pm25_mean_3h"] - 0.1) < 1e-12 and abs(r["pm25_mean_6h"] - 0.1) < 1e-12 for r in got[37:])
        assert got[1]["pm25_mean_3h"] == 1e17


@pytest.mark.parametrize("keys", [[], ["sensor_id"]])
def test_quantiles_equal_numpy(spark, keys):
    pdf = readings(3, 4000)
    pdf["pm25"] = pdf["pm25"] * np.where(pdf["i"] % 7 == 0, -1, 1) + np.random.default_rng(1).random(len(pdf)) * 1e-7
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = quantiles(to_spark(spark, pdf), "pm25", probs, keys).toPandas()
    if not keys:
        np.testing.assert_allclose(got.to_numpy()[0], pdf["pm25"].quantile(list(probs.values())))
        return
    expected = pdf.dropna().groupby("sensor_id")["pm25"].quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got.sort_values("sensor_id").set_index("sensor_id").to_numpy(), expected.to_numpy())


def test_approximate_quantiles_are_close(spark):
    pdf = readings(3, 4000).dropna()
    got = quantiles(to_spark(spark, pdf), "pm25", {"m": 0.5}, approx=True).first()["m"]
    assert got == pytest.approx(pdf["pm25"].median(), rel=0.02)


def test_latest_rows_come_from_the_input(spark):
    pdf = readings(9)
    df = to_spark(spark, pdf)
    newest = latest_per_sensor(df, "date", ["i"]).toPandas().set_index("sensor_id")["i"].sort_index()
    pd.testing.assert_series_equal(newest, pdf.groupby("sensor_id")["i"].max(), check_dtype=False)
    five = latest_n(df, 5, "date", ["i"]).toPandas()
    assert set(five["i"]) == set(pdf.sort_values("date").groupby("sensor_id").tail(5)["i"])


@FEW
@given(st.lists(st.floats(-1e4, 1e4, allow_nan=False).map(lambda v: round(v, 3)), min_size=1, max_size=60), st.integers(1, 60))
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "pm25 double")
    got = [r["frequency"] for r in D.histogram(df, bins=bins).orderBy("bin").collect()]
    assert sum(got) == len(values) and len(got) == bins
    lo, hi = min(values), max(values)
    if hi > lo:
        edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
        expected, _ = np.histogram(values, bins=edges)
        assert got == expected.tolist()


@FEW
@given(st.lists(st.floats(0.001, 2000, allow_nan=False), min_size=1, max_size=50))
def test_bands_cover_every_positive_value(spark, values):
    names = ["Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", risk_band(F.col("v")).alias("b")).collect():
        assert row["b"] == names[sum(row["v"] > t for t in (5, 15, 25, 35, 50))]


@FEW
@given(st.integers(0, 10_000))
def test_fill_never_changes_known_values_and_stays_between_neighbours(spark, seed):
    pdf = readings(seed, 200, 4)
    got = fill_gaps(to_spark(spark, pdf), order=["i"], bucket_hours=24).toPandas().set_index("i").sort_index()
    known = pdf["pm25"].notna()
    np.testing.assert_array_equal(got["pm25"][known], pdf["pm25"][known])
    for _, g in pdf.groupby("sensor_id"):
        before, after = g["pm25"].ffill(), g["pm25"].bfill()
        filled = got.loc[g["i"], "pm25"].to_numpy()
        low = np.fmin(before, after).to_numpy() - 1e-9
        high = np.fmax(before, after).to_numpy() + 1e-9
        ok = np.isnan(filled) | ((filled >= low) & (filled <= high))
        assert ok.all()


def test_sliced_position_axis_equals_unsliced(spark):
    pdf = readings(2).drop(columns="date")
    def run(rows):
        out = fill_gaps(to_spark(spark, pdf), ts="none", order=["i"], limit=3, max_bucket_rows=rows)
        return out.toPandas().set_index("i").sort_index()["pm25"].to_numpy(float)
    np.testing.assert_allclose(run(40), run(None))


def test_rows_without_key_are_not_filled(spark):
    pdf = readings(4, 300)
    df = to_spark(spark, pdf).withColumn("sensor_id", F.when(F.col("sensor_id") > 0, F.col("sensor_id")))
    got = fill_gaps(df, order=["i"]).where("sensor_id IS NULL").toPandas().set_index("i")["pm25"].sort_index()
    np.testing.assert_array_equal(got, pdf.set_index("i")["pm25"][got.index])
    assert fill_gaps(df, order=["i"], max_bucket_rows=5).count() == 300


def test_bursts_are_cut_until_no_slice_exceeds_its_limit(spark):
    """99,000 of 100,000 rows lie in a tenth of a second of one sensor; ten thousand share one time."""
    burst = spark.range(99_000).select(F.lit(1).cast("long").alias("sensor_id"), (F.col("id") + 10**15).alias("_us"))
    rest = spark.range(1000).select((F.col("id") % 3).alias("sensor_id"), (F.col("id") * 2_000_000_000 + 10**15).alias("_us"))
    same = spark.range(10_000).select(F.lit(2).cast("long").alias("sensor_id"), F.lit(10**15 + 5).cast("long").alias("_us"))
    rows = burst.unionByName(rest).unionByName(same).withColumn("_bucket", F.lit(10**15 - 7).cast("long"))
    cut = series._sliced(rows, ["sensor_id"], 2000)
    sizes = cut.groupBy("sensor_id", "_bucket").agg(F.count("_us").alias("n"), F.min("_us").alias("a"), F.max("_us").alias("b")).collect()
    assert all(r.n <= 2000 or r.a == r.b for r in sizes) and sum(r.n for r in sizes) == 110_000 and len(sizes) < 400
    for sensor in (0, 1, 2):  # slices follow one another
        mine = sorted((r._bucket, r.a, r.b) for r in sizes if r.sensor_id == sensor)
        assert all(x[2] < y[1] and x[0] < y[0] for x, y in zip(mine, mine[1:]))


@pytest.mark.parametrize("widths", [[], [10], [10, 1000], [1, 1, 10**6]])
def test_blockwise_scan_equals_one_window(spark, widths):
    rng = np.random.RandomState(5)
    rows = [(int(g), int(b), None if rng.rand() < 0.3 else int(b) * 10, int(rng.randint(0, 9)))
            for g in range(3) for b in sorted(set(rng.randint(-2000, 2000, 300)))]
    df = spark.createDataFrame(rows, "g int, at long, knot long, n long")
    scans = [("before", "knot", "max", "before"), ("start", "n", "sum", "before")]
    got = series.carried_over(df, ["g"], "at", widths, scans)
    later = series.carried_over(df, ["g"], "at", widths, [("after", "knot", "min", "after")])
    both = got.join(later.select("g", "at", "after"), ["g", "at"]).toPandas().sort_values(["g", "at"])
    for _, part in both.groupby("g"):
        np.testing.assert_array_equal(part["before"], part["knot"].ffill().shift())
        np.testing.assert_array_equal(part["after"], part["knot"].bfill().shift(-1))
        np.testing.assert_array_equal(part["start"].fillna(0), part["n"].cumsum().shift().fillna(0))


def test_quantiles_of_many_values_in_a_narrow_range(spark, monkeypatch):
    """200,000 distinct values within a millionth, copies, infinities and tiny values; ranges are cut again and again."""
    from hazeline.operators import quantiles as Q

    monkeypatch.setattr(Q, "SMALL", 500)
    rng = np.random.RandomState(9)
    values = np.concatenate([100 + rng.rand(200_000) * 1e-6, np.full(3000, 100.0000005), rng.normal(size=500) * 1e-9,
                             [np.inf, -np.inf, 1e300, -1e300, 5e-324, 0.0, -0.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "k": np.where(np.arange(len(values)) % 3 == 0, 1, 2)}))
    probs = {f"p{i}": p for i, p in enumerate((0.001, 0.25, 0.5, 0.9, 0.9999))}
    ends = quantiles(df, "v", {"least": 0.0, "greatest": 1.0}).first()
    assert (ends.least, ends.greatest) == (-np.inf, np.inf)
    got = quantiles(df, "v", probs).first()
    with np.errstate(invalid="ignore"):
        assert [got[n] for n in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))), rel=1e-15)
        for r in quantiles(df, "v", {"m": 0.5, "q": 0.77}, ["k"]).collect():
            mine = values[np.arange(len(values)) % 3 == 0] if r.k == 1 else values[np.arange(len(values)) % 3 != 0]
            assert [r.m, r.q] == pytest.approx(list(np.quantile(mine, [0.5, 0.77])), rel=1e-15)
