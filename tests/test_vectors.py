"""Small inputs with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hazeline.functions import columns as C, constants as K, risk as R
from hazeline.functions.numeric import epoch_micros, floor_div, round_stable
from hazeline.operators import aggregate as A, clean, distribution as D, filters as X
from hazeline.operators.forecast import seasonal_forecast
from hazeline.operators.health import health_rollup
from hazeline.operators import joins
from hazeline.operators.joins import attach, live_or_archive
from hazeline.operators.latest import keep_first, latest_per_sensor, latest_snapshot
from hazeline.operators.quantiles import quantiles
from hazeline.operators.series import fill_gaps, resample_daily

SERIES = [None, 1.0, None, None, None, None, 6.0, None, None]
DAYS = [1, 2, 3, 5, 6, 7, 11, 12, 13]


def day(n):
    return dt.datetime(2025, 1, n)


def series(spark, values, days, sensor=1):
    rows = [(i, sensor, day(d), v) for i, (v, d) in enumerate(zip(values, days))]
    return spark.createDataFrame(rows, "i int, sensor_id int, date timestamp, pm25 double")


def fill(df, method, limit=7, **kw):
    out = fill_gaps(df, "pm25", "date", order=["i"], method=method, limit=limit, **kw).orderBy("i").collect()
    return [r["pm25"] for r in out]


CASES = [
    ("interpolate_time", 7, [None, 1, 1.5555556, 2.6666667, 3.2222222, 3.7777778, 6, 6, 6]),
    ("interpolate_linear", 7, [None, 1, 2, 3, 4, 5, 6, 6, 6]),
    ("interpolate_linear", 2, [None, 1, 2, 3, None, None, 6, 6, 6]),
    ("ffill", 2, [None, 1, 1, 1, None, None, 6, 6, 6]),
    ("bfill", 2, [1, 1, None, None, 6, 6, 6, None, None]),
    ("mean", 7, [3.5, 1, 3.5, 3.5, 3.5, 3.5, 6, 3.5, 3.5]),
]


@pytest.mark.parametrize("bucket_hours", [24, 72, 24 * 365])
@pytest.mark.parametrize("method,limit,expected", CASES)
def test_fill(spark, method, limit, expected, bucket_hours):
    got = fill(series(spark, SERIES, DAYS), method, limit, bucket_hours=bucket_hours)
    for g, e in zip(got, expected, strict=True):
        assert g is None if e is None else g == pytest.approx(e, abs=1e-6)


@pytest.mark.parametrize("values,expected", [
    ([0, 1, None, 5, 9], [0, 1, 5, 5, 9]),
    ([0, 1, None, None, 9], [0, 1, 1, 1, 9]),
    ([0, None, 1, None, 9], [0, 1, 1, 1, 9]),
])
def test_time_fill_with_equal_times(spark, values, expected):
    df = series(spark, [None if v is None else float(v) for v in values], [1, 2, 2, 2, 3])
    assert fill(df, "interpolate_time") == expected


def test_fill_leaves_rows_without_time_alone(spark):
    df = series(spark, [1.0, None, 3.0], [1, 2, 3]).unionByName(
        spark.createDataFrame([(9, 1, None, None), (10, 1, None, 50.0)], "i int, sensor_id int, date timestamp, pm25 double"))
    for method in ("interpolate_time", "interpolate_linear", "ffill", "bfill"):
        got = fill(df, method)
        assert got[3:] == [None, 50.0] and got[1] in (2.0, 1.0, 3.0)


def test_fill_without_time_column_is_linear(spark):
    df = series(spark, SERIES, DAYS).drop("date")
    for method in ("ffill", "mean", "interpolate_time"):
        assert fill(df, method) == [None, 1, 2, 3, 4, 5, 6, 6, 6]
    with pytest.raises(ValueError):
        fill_gaps(df, "pm25", "date")


def test_fill_rejects_unknown_method(spark):
    with pytest.raises(ValueError):
        fill(series(spark, SERIES, DAYS), "spline")


def test_fill_keeps_sensors_apart(spark):
    df = series(spark, [1.0, None, 3.0], [1, 2, 3]).unionByName(series(spark, [None, 9.0, None], [1, 2, 3], 2))
    out = {(r["sensor_id"], r["i"]): r["pm25"] for r in fill_gaps(df, order=["i"]).collect()}
    assert out[(1, 1)] == 2.0 and out[(2, 0)] is None and out[(2, 2)] == 9.0


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    row = quantiles(df, "v", {"a": 0.1, "b": 0.25, "c": 0.0, "d": 1.0}).first()
    assert row["a"] == pytest.approx(1.3) and row["b"] == pytest.approx(1.75) and (row["c"], row["d"]) == (1, 4)


@pytest.mark.parametrize("values,bins,counts,lo,hi", [
    ((0, 1, 2, 3, 4, 5), 5, [1, 1, 1, 1, 2], 0, 5),
    ((5, 5, 5), 3, [0, 3, 0], 4.5, 5.5),
])
def test_histogram(spark, values, bins, counts, lo, hi):
    out = D.histogram(spark.createDataFrame([(float(v),) for v in values], "pm25 double"), bins=bins).orderBy("bin").collect()
    assert [r["frequency"] for r in out] == counts
    assert out[0]["bin_start"] == lo and out[-1]["bin_end"] == hi


def test_histogram_of_nothing_is_empty(spark):
    assert D.histogram(spark.createDataFrame([(None,)], "pm25 double")).count() == 0


def test_daily_stats_drop_missing_keys_and_count_metadata_copies(spark):
    m = spark.createDataFrame(
        [(day(1), 1, 10.0), (day(1), 1, 20.0), (day(1), 2, 5.0), (day(1), 3, 7.0), (day(1), None, 1.0)],
        "datetime timestamp, sensor_id int, pm25 double").withColumn("date", F.to_date("datetime"))
    s = spark.createDataFrame([(1, 100), (1, 100), (2, 200), (3, None)], "sensor_id int, station_id int")
    out = {r["sensor_id"]: r for r in A.daily_sensor_stats(m, s, ["station_id"], min_rows=1).collect()}
    assert set(out) == {1, 2}
    # each reading of sensor 1 counts twice: 10, 10, 20, 20
    assert out[1]["measurements_count"] == 4 and out[1]["pm25_std"] == pytest.approx(5.77)
    assert out[2]["pm25_std"] is None
    assert A.daily_sensor_stats(m, s, ["station_id"], min_rows=18).count() == 0


def test_resample(spark):
    df = spark.createDataFrame([(1, day(1), 1.0), (1, day(1), 2.0), (1, day(4), 4.0)],
                               "sensor_id int, t timestamp, pm25 double").withColumn("date", F.to_date("t"))
    assert [r["pm25_mean"] for r in resample_daily(df).orderBy("date").collect()] == [1.5, None, None, 4.0]


def test_top_by_mean_ties_take_lower_id(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, 7.0)], "sensor_id int, pm25 double")
    assert [r["sensor_id"] for r in A.top_by_mean(df, 2).collect()] == [2, 3]


def test_risk_band(spark):
    points = [-1, 0, 0.1, 5, 5.1, 15, 25, 35, 50, 50.1, None]
    expected = ["Unknown", "Unknown", "Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups",
                "Unhealthy", "Very Unhealthy", "Hazardous", "Unknown"]
    df = spark.createDataFrame([(i, None if p is None else float(p)) for i, p in enumerate(points)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(R.risk_band(F.col("v"))).collect()] == expected


def test_nan_has_no_band(spark):
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(R.risk_band(F.col("v")), *R.excess_risk_columns(F.col("v")))
    assert set(nan.first()) == {"Unknown", None}


def test_estimator_category(spark):
    points = [-1, 5, 10, 15, 20, 25, 30]
    expected = ["Good", "Good", "Moderate", "Moderate", "Very Unhealthy", "Very Unhealthy", "Hazardous"]
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "i int, v double")
    assert [r[0]["category"] for r in df.orderBy("i").select(R.estimator_category(F.col("v"))).collect()] == expected
    assert spark.range(1).select(R.estimator_category(F.lit(None).cast("double"))).first()[0]["color"] == "maroon"


def test_excess_mortality(spark):
    points, expected = [5, 12.4, 53.4, 54.8, 58.3], [None, 4.6, 33.8, 34.9, 37.8]
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(R.excess_percent(F.col("v"), 1.062)).collect()] == expected
    sizes = [len(r[0]) for r in df.select(R.excess_risk_map(F.col("v"))).collect()]
    assert sizes == [0, 4, 4, 4, 4]


def test_population_impact_of_the_published_mean(spark):
    row = spark.range(1).select(*R.population_impact_columns(F.lit(41.363333))).first()
    assert (row["premature_deaths_per_year"], row["hospital_admissions_per_year"], row["lost_work_days_per_year"]) == (3636, 7273, 36363)


def test_profile_advice(spark):
    def text(profile, v):
        return spark.range(1).select(R.profile_advice(F.lit(profile), F.lit(float(v)))).first()[0]
    assert text("sensitive", 15) == "Generally safe, keep medication handy"
    assert text("athlete", 25.5) == "Train indoors today"
    assert text("elderly", 16) == "Remain indoors"
    assert text("parent", 25) == "Limit outdoor play to 1 hour"
    assert spark.range(1).select(R.profile_of_choice(F.lit("9"))).first()[0] == K.DEFAULT_PROFILE
    assert spark.range(1).select(R.profile_of_choice(F.lit("3"))).first()[0] == "elderly"


def test_district_display_name(spark):
    df = spark.createDataFrame([("nor-nork",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(R.district_display_name(F.col("s"))).collect()] == ["Nor Nork", "other", None]


def test_forecast_decay(spark):
    # mean 5, last 10: the steps after the first 24 decay towards the mean on rounded values
    history = [(0, day(1) + dt.timedelta(hours=i), 110 / 23 if i < 23 else 10.0) for i in range(24)]
    df = spark.createDataFrame(history, "sensor_id int, datetime timestamp, pm25 double")
    steps = seasonal_forecast(df, 27, noise_sd=0).orderBy("step").collect()
    assert len(steps) == 27 and steps[23]["forecast"] == 10.0
    assert [r["forecast"] for r in steps[24:]] == [9.8, 9.6, 9.4]
    assert steps[0]["forecast_time"] == day(1) + dt.timedelta(hours=24)
    assert seasonal_forecast(df.limit(23), 24).count() == 0
    assert seasonal_forecast(df, 99, noise_sd=0).count() == 48 and seasonal_forecast(df, 0, noise_sd=0).count() == 1


def test_forecast_noise_is_repeatable_and_centred(spark):
    df = spark.range(24 * 200).select((F.col("id") % 200).alias("sensor_id"), F.lit(100.0).alias("pm25"),
                                      F.timestamp_seconds(F.col("id")).alias("datetime"))
    a = seasonal_forecast(df, 24).agg(F.avg("forecast"), F.stddev("forecast")).first()
    b = seasonal_forecast(df.repartition(7), 24).agg(F.avg("forecast"), F.stddev("forecast")).first()
    assert a[0] == pytest.approx(b[0]) and a[0] == pytest.approx(100, abs=0.5) and a[1] == pytest.approx(5, abs=0.4)


def test_rounding(spark):
    df = spark.createDataFrame([(2.344999,), (2.345,), (-1.005,), (None,)], "v double")
    assert [r[0] for r in df.select(round_stable(F.col("v"), 2)).collect()] == [2.34, 2.35, -1.0, None]
    close = spark.createDataFrame([(12.344999995,), (12.345000001,), (float("nan"),)], "v double")
    assert [r[0] for r in close.select(round_stable(F.col("v"), 2)).collect()] == [12.34, 12.35, None]


def test_epoch_micros_ignores_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.999999' a UNION ALL SELECT timestamp_ntz'2024-03-31 02:30:00.5'")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = [r[0] for r in df.select(epoch_micros(df, "a")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(got) == [-1, 1711852200500000]
    assert sorted(r[0] for r in df.select(epoch_micros(df, "a")).collect()) == [-1, 1711852200500000]
    assert spark.range(1).select(floor_div(F.lit(-1).cast("long"), 10)).first()[0] == -1


def test_value_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)], "`pm2.5_corrected` double, `pm2.5` double, pm10 double")
    assert C.resolve_value(df).select("pm25").first()[0] == 2.0
    assert set(C.resolve_value(df, keep_source=True).columns) == {*df.columns, "pm25"}
    late = spark.createDataFrame([(None, 3.0), (1.0, 2.0)], "`pm2.5` double, pm25 double")
    assert [r["pm25"] for r in C.resolve_value(late).collect()] == [None, 1.0]
    assert [r["pm25"] for r in C.resolve_value(late, mode="coalesce").collect()] == [3.0, 1.0]
    assert C.detect_value_column(spark.createDataFrame([(1, 1, 1)], "pm10 int, pm1 int, `pm2.5` int")) == "pm1"
    assert C.find_value_column(["a", "my_PM25_x"], "tolerant") == "my_PM25_x"
    with pytest.raises(ValueError):
        C.detect_value_column(spark.createDataFrame([(1,)], "pm10 int"))


def test_key_alignment(spark):
    assert C.align_key(spark.createDataFrame([("41",)], "sensor_id string")).first()[0] == 41
    assert C.align_key(spark.createDataFrame([(41,)], "sensor_id int"), kind="str").first()[0] == "41"
    with pytest.raises(Exception, match="missing sensor_id"):
        C.align_key(spark.createDataFrame([(None,)], "sensor_id int")).collect()


def test_negative_filter_keeps_missing_only_without_negatives(spark):
    with_neg = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "pm25 double")
    without = with_neg.where("pm25 IS NULL OR pm25 >= 0")
    assert X.drop_negative(with_neg).count() == 1 and X.drop_negative(without).count() == 2
    assert X.drop_negative(with_neg, keep_null=True).count() == 2


def test_year_span():
    assert X.year_span(2025) == (2025, 2025) and X.year_span((2019, 2021)) == (2019, 2021)
    for bad in ([2019, 2020, 2021], "2025", None):
        with pytest.raises(ValueError):
            X.year_span(bad)


def test_filters(spark):
    df = spark.createDataFrame([(1, "PM25", 2019, 1), (2, None, 2020, 2), (3, "temp", 2021, 3)],
                               "sensor_id int, parameter string, year int, month int")
    assert X.pm25_parameter_only(df).count() == 1
    assert X.only_sensors(df, [1, 2]).count() == 2 and X.only_sensors(df, []).count() == 3
    assert X.in_months(df, (2019, 2020), [2]).count() == 1


def test_distinct_treats_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1.0)], "a int, b double")
    assert clean.distinct_rows(df).count() == 2


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k int, o int, v string")
    assert {(r["k"], r["v"]) for r in keep_first(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "b")}


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_outliers(spark, method):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 21), 500]], "pm25 double")
    left = [r[0] for r in clean.outliers_to_null(df, method=method).collect()]
    assert left.count(None) == 1 and 500.0 not in left
    same = spark.createDataFrame([(5.0,)] * 4, "pm25 double")
    assert clean.outliers_to_null(same, method=method).where("pm25 IS NULL").count() == 0
    empty = spark.createDataFrame([(None,)], "pm25 double")
    assert clean.outliers_to_null(empty, method=method).count() == 1
    with pytest.raises(ValueError):
        clean.outliers_to_null(df, method="mad")


def test_zscore_uses_population_deviation(spark):
    values = [0.0] * 10 + [1.0]
    mean = 1 / 11
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 11)
    z = (1 - mean) / sd
    df = spark.createDataFrame([(v,) for v in values], "pm25 double")
    assert clean.outliers_to_null(df, method="zscore", threshold=z - 1e-9).where("pm25 IS NULL").count() == 1
    assert clean.outliers_to_null(df, method="zscore", threshold=z + 1e-9).where("pm25 IS NULL").count() == 0


def test_basic_clean_is_idempotent_and_parses_dates(spark):
    df = spark.createDataFrame([("2025-01-01", -1.0), ("2025-01-01", -1.0), ("2025-01-02", 2.0)], "date string, pm25 double")
    once = clean.basic_clean(df)
    assert dict(once.dtypes)["date"] == "timestamp"
    assert sorted(once.collect(), key=str) == sorted(clean.basic_clean(once).collect(), key=str)
    assert once.count() == 2 and once.where("pm25 IS NULL").count() == 1


def test_cleaning_log_and_summary(spark):
    df = series(spark, [1.0, -1.0, 3.0, 3.0], [1, 2, 3, 4])
    df = df.unionAll(df.where("i = 0"))
    log = {r["step"]: r["rows"] for r in clean.cleaning_log(df, order=["i"]).collect()}
    assert log == {"duplicates_removed": 1, "negatives_to_null": 1, "outliers_to_null": 0, "gaps_filled": 1}
    assert clean.cleaning_summary(clean.cleaning_log(df, order=["i"])).count() == 3


def test_log_is_filled_by_the_run_that_cleans(spark):
    df = series(spark, [1.0, -1.0, 3.0, 3.0, 2.0, 2.5, 1.5, 2.0, 1000.0], list(range(1, 10)))
    log = clean.CleaningLog()
    out = clean.clean_series(df.unionAll(df.where("i < 2")), order=["i"], log=log)
    assert out.columns == df.columns
    got = {r.i: r.pm25 for r in out.collect()}
    assert len(got) == 9 and got[1] == 2.0 and got[8] == 2.0
    assert {r.step: r.rows for r in log.frame(spark).collect()} == {
        "duplicates_removed": 2, "negatives_to_null": 1, "outliers_to_null": 1, "gaps_filled": 2}


def test_latest(spark):
    df = spark.createDataFrame([(0, day(3), 1.0), (1, day(3), 2.0), (2, day(2), 3.0), (1, day(1), 9.0)],
                               "sensor_id int, datetime timestamp, pm25 double")
    assert {r["sensor_id"] for r in latest_snapshot(df).collect()} == {0, 1}
    assert latest_snapshot(df.drop("datetime")).count() == 4
    assert {(r["sensor_id"], r["pm25"]) for r in latest_per_sensor(df).collect()} == {(0, 1.0), (1, 2.0), (2, 3.0)}
    assert {r["sensor_id"] for r in latest_per_sensor(df, skip_falsy_keys=True).collect()} == {1, 2}


def test_live_or_archive(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "sensor_id int")
    live = spark.createDataFrame([(1, 10.0)], "sensor_id int, pm25 double")
    past = spark.createDataFrame([(1, 99.0), (2, 20.0)], "sensor_id int, pm25 double")
    got = {(r["sensor_id"], r["pm25"], r["source"]) for r in live_or_archive(ids, live, past).collect()}
    assert got == {(1, 10.0, "LIVE"), (2, 20.0, "FILE")}


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_attach_salted_equals_plain_join(spark, how):
    facts = spark.range(500).select(F.when(F.col("id") < 300, 1).when(F.col("id") < 310, None)
                                     .otherwise(F.col("id") % 40).alias("sensor_id"), "id")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (77, "d"), (None, "e")], "sensor_id int, name string")
    def rows(df):
        return sorted(map(str, df.select("sensor_id", "id", "name").collect()))
    expected = rows(facts.join(dim, "sensor_id", how))
    assert rows(attach(facts, dim, how=how)) == expected
    assert rows(attach(facts, dim, how=how, max_rows=2, heavy_rows=50)) == expected
    assert rows(attach(facts, dim, how=how, max_rows=2)) == expected


def test_only_heavy_keys_are_cut(spark):
    """A third of the rows on one key: it is cut, and the dimension is repeated for it alone."""
    facts = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("int").alias("sensor_id"), "id")
    dim = spark.range(5000).withColumnRenamed("id", "sensor_id").withColumn("name", F.col("sensor_id").cast("string"))
    common = facts.select("sensor_id").unionAll(dim.select("sensor_id")).schema
    heavy = joins.heavy_keys(facts, ["sensor_id"], joins._key_hash(["sensor_id"], common), 1000).collect()
    assert [r._parts for r in heavy] == [11]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach(facts, dim, max_rows=10, heavy_rows=1000).withColumn("task", F.spark_partition_id())
        counts = out.where("sensor_id = 7").groupBy("task").count().collect()
        assert len(counts) == 4 and max(r["count"] for r in counts) < 6000  # all four tasks of the session
        assert out.count() == 30_000 and out.where("name is null or name <> cast(sensor_id as string)").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_attach_edge_cases(spark):
    df = spark.range(3)
    assert attach(df, df.withColumnRenamed("id", "sensor_id")).columns == ["id"]
    with pytest.raises(ValueError):
        attach(df, df, "id", "cross")


def test_boxplot(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 1.0), (None, 5.0)], "g string, pm25 double")
    out = {r["g"]: r for r in D.boxplot_stats(df, ["g"]).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["q1"], out["a"]["median"], out["a"]["q3"]) == (2, 3, 4)
    assert (out["a"]["whisker_low"], out["a"]["whisker_high"], out["a"]["outliers"]) == (1, 4, 1)
    assert D.boxplot_outliers(df, ["g"]).collect()[0]["value"] == 100


def test_exceedance_counts_missing_as_no(spark):
    row = A.exceedance(spark.createDataFrame([(6.0,), (30.0,), (None,), (1.0,)], "pm25 double")).first()
    assert (row["pct_above_guideline"], row["pct_hazardous"], row["data_points"]) == (50.0, 25.0, 4)


def test_live_summary_skips_zero(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,), (None,)], "pm25 double")
    assert A.live_summary(df).first()["sensor_count"] == 2
    assert A.live_summary(df, skip_zero=False).first()["min_pm25"] == 0.0


def test_rollup_averages_rounded_means(spark):
    row = health_rollup(spark.createDataFrame([(10.01,), (20.02,)], "mean_pm25 double")).first()
    assert row["avg_pm25"] == pytest.approx(15.015) and row["sensors"] == 2
