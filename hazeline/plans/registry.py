"""Named queries over the Parquet tables, one per operator or report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hazeline.functions.columns import with_calendar
from hazeline.functions.numeric import round_stable
from hazeline.functions.risk import (
    district_display_name, estimator_category, excess_risk_columns, excess_risk_entries, population_impact_columns,
    profile_advice, recommendation, risk_band, risk_message,
)
from hazeline.operators import aggregate as A, clean as C, distribution as D, filters as X, joins as J, learn
from hazeline.operators.forecast import seasonal_forecast
from hazeline.operators import partials as P
from hazeline.operators.keyed_trees import train_keyed
from hazeline.operators.health import health_rollup, health_summary
from hazeline.operators.latest import (
    as_readings, first_n_per_group, keep_first, last_observed_days, latest_n, latest_per_sensor, latest_snapshot,
)
from hazeline.operators.series import fill_gaps, resample_daily, rolling_means
from hazeline.plans import archived, quality, reports as R
from hazeline.session import fresh_path
from hazeline.sources import tables as S
from hazeline.streaming import live as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(archived.QUERIES)
PLACE = ("station_id", "area")
TIE = ("event_id",)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def settled(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded so that summation order does not show in comparisons."""
    return df.select(*[round_stable(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _dated(spark, d):
    return with_calendar(S.measurements(spark, d), "datetime")


def _placed(spark, d):
    """Readings joined to the sensor metadata (whole table, unmatched readings kept)."""
    return J.attach(S.measurements(spark, d), S.sensors(spark, d))


def _latest(spark, d):
    return latest_per_sensor(S.measurements(spark, d), tie=TIE)


def _live_and_archive(spark, d):
    """The last day as live readings (newest per sensor), everything before as archive."""
    m = _dated(spark, d)
    last_day = m.agg(F.max("date")).scalar()
    live = latest_per_sensor(m.where(F.col("date") == last_day), tie=TIE)
    return live.select("sensor_id", "pm25", "datetime"), m.where(F.col("date") < last_day).drop("date", "hour")


def _with_district(spark, d):
    """Customers as the sensors asked for; those that are suppliers have a district."""
    districts = S.sensors(spark, d).select("sensor_id", F.col("district_slug").alias("district"))
    return J.attach(_customers(spark, d).select("sensor_id"), districts)


# --- daily, hourly and grouped statistics -------------------------------------------------------

@query
def daily_sensor_stats(spark, d):
    m = X.valid_readings(_dated(spark, d))
    out = A.daily_sensor_stats(m, S.sensors(spark, d), PLACE, min_rows=4)
    return out.withColumn("risk_level", risk_band(F.col("pm25_mean")))


@query
def daily_type_stats(spark, d):
    return settled(A.grouped_stats(_dated(spark, d), ["date", "event_type"], min_rows=18))


@query
def city_daily_mean(spark, d):
    return settled(A.daily_mean(_dated(spark, d)))


@query
def hourly_profile(spark, d):
    return settled(A.hourly_profile(_dated(spark, d)))


@query
def district_top10(spark, d):
    return A.district_stats(S.measurements(spark, d), S.sensors(spark, d), 10)


@query
def district_top8(spark, d):
    return settled(A.district_means(S.measurements(spark, d), S.sensors(spark, d), 8))


@query
def station_mean(spark, d):
    return settled(A.station_means(S.measurements(spark, d), S.sensors(spark, d)))


@query
def sensor_location_mean(spark, d):
    return settled(A.location_means(S.measurements(spark, d), S.sensors(spark, d), PLACE))


@query
def summary_percentiles(spark, d):
    return settled(A.summary(S.raw_measurements(spark, d)))


@query
def describe(spark, d):
    return settled(A.describe(S.measurements(spark, d)))


@query
def describe_per_sensor(spark, d):
    return settled(A.describe(S.measurements(spark, d), keys=["sensor_id"]))


@query
def exceedance(spark, d):
    return A.exceedance(S.raw_measurements(spark, d), ["sensor_id"])


@query
def exceedance_flags(spark, d):
    return X.flag_exceedance(S.raw_measurements(spark, d)).select("event_id", "above_guideline", "hazardous")


@query
def top_sensors_by_count(spark, d):
    return A.rows_per_sensor(S.measurements(spark, d))


@query
def top_sensors_by_mean(spark, d):
    return settled(A.top_by_mean(S.measurements(spark, d)))


@query
def distinct_and_range(spark, d):
    return A.distinct_and_range(_placed(spark, d), ["sensor_id", "station_id"])


@query
def data_quality(spark, d):
    return A.data_quality(S.raw_measurements(spark, d))


@query
def live_summary(spark, d):
    return settled(A.live_summary(_latest(spark, d)))


@query
def sensors_by_district(spark, d):
    return A.sensors_by_district(S.sensors(spark, d), "district_slug")


# --- distribution -------------------------------------------------------------------------------

@query
def histogram50(spark, d):
    return settled(D.histogram(S.measurements(spark, d)))


@query
def district_boxplot(spark, d):
    return settled(D.boxplot_stats(_placed(spark, d), ["district_slug"]))


@query
def boxplot_outliers(spark, d):
    return D.boxplot_outliers(_placed(spark, d), ["district_slug"])


# --- bands, risks, advice -----------------------------------------------------------------------

@query
def risk_bands(spark, d):
    v = F.col("pm25")
    return S.raw_measurements(spark, d).select(
        "event_id", risk_band(v).alias("risk_level"), risk_message(v).alias("risk_message"))


@query
def category_estimator(spark, d):
    return S.raw_measurements(spark, d).select("event_id", estimator_category(F.col("pm25")).alias("c")) \
        .select("event_id", "c.category", "c.color")


@query
def excess_risk_short(spark, d):
    return S.measurements(spark, d).select("event_id", *excess_risk_columns(F.col("pm25")))


@query
def excess_risk_long(spark, d):
    means = A.daily_mean(_dated(spark, d))
    return means.select("date", F.inline(excess_risk_entries(F.col("pm25_mean"))))


@query
def population_impact(spark, d):
    means = A.daily_mean(_dated(spark, d))
    return means.select("date", *population_impact_columns(F.col("pm25_mean")))


@query
def recommendation_latest(spark, d):
    return _latest(spark, d).select("sensor_id", "pm25", recommendation(F.col("pm25")).alias("recommendation"))


@query
def profile_advice_latest(spark, d):
    return R.personal_advice(_latest(spark, d).select("sensor_id", "pm25"))


@query
def profile_advice_rows(spark, d):
    """P15 with the profile taken from the row: each event type stands for one kind of user."""
    kind = (F.when(F.col("event_type") == "click", "sensitive").when(F.col("event_type") == "view", "athlete")
             .when(F.col("event_type") == "signup", "elderly").otherwise("parent"))
    return S.measurements(spark, d).select("event_id", kind.alias("profile"),
                                           profile_advice(kind, F.col("pm25")).alias("advice"))


@query
def district_names(spark, d):
    return S.sensors(spark, d).select("sensor_id", district_display_name(F.col("district_slug")).alias("district"))


@query
def health_summary_sensors(spark, d):
    out = health_summary(S.measurements(spark, d), S.sensors(spark, d), ["district_slug", "area"])
    return out.drop("excess_health_risks")


@query
def health_risks_long(spark, d):
    out = health_summary(S.measurements(spark, d))
    return out.select("sensor_id", F.inline("excess_health_risks")).drop("description")


@query
def health_rollup_city(spark, d):
    return settled(health_rollup(health_summary(S.measurements(spark, d))))


@query
def health_report_lines(spark, d):
    return R.health_report(S.measurements(spark, d), S.sensors(spark, d))["lines"]


# --- filters, joins, sets -----------------------------------------------------------------------

@query
def valid_readings(spark, d):
    return X.valid_readings(S.raw_measurements(spark, d)).select("event_id", "pm25")


@query
def non_negative_readings(spark, d):
    return X.drop_negative(S.raw_measurements(spark, d)).select("event_id", "pm25")


@query
def recent_readings(spark, d):
    m = S.measurements(spark, d)
    return X.since(m, m.agg(F.max("datetime")).scalar(), 7, "datetime").select("event_id", "datetime")


@query
def calendar_parts(spark, d):
    return _dated(spark, d).select("event_id", "date", "hour")


@query
def semi_allow_list(spark, d):
    return X.allow_listed(S.measurements(spark, d), S.sensors(spark, d).select("sensor_id")).select("event_id")


@query
def district_lookup(spark, d):
    dim = S.sensors(spark, d).select("sensor_id", F.col("district_slug").alias("district"))
    return J.lookup(S.measurements(spark, d), dim, "sensor_id", "district", "Unknown") \
        .select("event_id", "sensor_id", "district")


@query
def join_left(spark, d):
    return _placed(spark, d).select("event_id", "sensor_id", "station_id", "district_slug", "pm25")


@query
def join_inner(spark, d):
    return J.attach(S.measurements(spark, d), S.sensors(spark, d), how="inner").select("event_id", "district_slug")


def _customers(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("sensor_id"), "c_mktsegment")


@query
def join_right(spark, d):
    return J.attach(S.measurements(spark, d), _customers(spark, d), how="right") \
        .select("event_id", "sensor_id", "c_mktsegment")


@query
def join_outer(spark, d):
    dim = _customers(spark, d)
    placed = J.attach(S.measurements(spark, d), S.sensors(spark, d), how="outer")
    return J.attach(placed, dim, how="outer").select("event_id", "sensor_id", "area", "c_mktsegment")


@query
def union_by_name(spark, d):
    m = S.measurements(spark, d)
    b = S.bulk_measurements(spark, d).select("datetime", "sensor_id", "pm25", F.col("l_orderkey").alias("order_id"))
    return J.union_by_name(m.select("event_id", "sensor_id", "pm25"), b)


@query
def live_or_archive(spark, d):
    live, past = _live_and_archive(spark, d)
    means = past.groupBy("sensor_id").agg(F.avg("pm25").alias("pm25"))
    wanted = _customers(spark, d).select("sensor_id")
    return settled(J.live_or_archive(wanted, live, means))


# --- cleaning -----------------------------------------------------------------------------------

@query
def dedup_rows(spark, d):
    return C.distinct_rows(S.raw_measurements(spark, d))


@query
def dedup_key_first(spark, d):
    return keep_first(S.measurements(spark, d), ["sensor_id", "event_type"], ["datetime", "event_id"])


@query
def basic_clean(spark, d):
    return C.basic_clean(S.raw_measurements(spark, d), day="datetime")


@query
def outliers_iqr(spark, d):
    return C.outliers_to_null(S.raw_measurements(spark, d), method="iqr").select("event_id", "pm25")


@query
def outliers_iqr_per_sensor(spark, d):
    return C.outliers_to_null(S.raw_measurements(spark, d), method="iqr", threshold=1.5, keys=["sensor_id"]) \
        .select("event_id", "pm25")


@query
def outliers_zscore(spark, d):
    return C.outliers_to_null(S.raw_measurements(spark, d), method="zscore").select("event_id", "pm25")


@query
def clean_series(spark, d):
    return settled(C.clean_series(S.raw_measurements(spark, d), ts="datetime", order=TIE))


@query
def cleaning_log(spark, d):
    """The log of one cleaning run, counted while it ran."""
    return C.cleaning_log(S.raw_measurements(spark, d), ts="datetime", order=TIE)


# --- gaps, resampling, rolling ------------------------------------------------------------------

def _filled(spark, d, method, keys=("sensor_id",)):
    g = S.sparse_measurements(spark, d)
    return settled(fill_gaps(g, "pm25", "datetime", keys, TIE, method).select("event_id", "pm25"))


@query
def fill_time(spark, d):
    return _filled(spark, d, "interpolate_time")


@query
def fill_time_whole_table(spark, d):
    return _filled(spark, d, "interpolate_time", ())


@query
def fill_linear(spark, d):
    return _filled(spark, d, "interpolate_linear")


@query
def fill_linear_whole_table(spark, d):
    return _filled(spark, d, "interpolate_linear", ())


@query
def fill_ffill(spark, d):
    return _filled(spark, d, "ffill")


@query
def fill_bfill(spark, d):
    return _filled(spark, d, "bfill")


@query
def fill_mean(spark, d):
    return _filled(spark, d, "mean")


@query
def resample_daily_top5(spark, d):
    m = _dated(spark, d)
    return settled(resample_daily(X.allow_listed(m, A.top_by_mean(m, 5), fixed_size=True)))


@query
def rolling_features(spark, d):
    return settled(rolling_means(S.measurements(spark, d)).select("event_id", "pm25_mean_3h", "pm25_mean_6h"))


# --- latest, trend, forecast --------------------------------------------------------------------

@query
def latest_snapshot_rows(spark, d):
    return as_readings(latest_snapshot(S.measurements(spark, d)), "CSV download").drop("file_time")


@query
def latest_snapshot_bulk(spark, d):
    return latest_snapshot(S.bulk_measurements(spark, d))


@query
def latest_per_sensor_rows(spark, d):
    return _latest(spark, d)


@query
def latest_keyed_table(spark, d):
    """W2 with the original lookup's habit of leaving out sensor 0."""
    return latest_per_sensor(S.measurements(spark, d), tie=TIE, skip_falsy_keys=True).select("sensor_id", "pm25")


@query
def latest_24_per_sensor(spark, d):
    return latest_n(S.measurements(spark, d), 24, tie=TIE).select("event_id", "sensor_id")


@query
def first_5_per_type(spark, d):
    return first_n_per_group(S.measurements(spark, d), 5, ["event_type"], ["datetime", "event_id"]) \
        .select("event_id", "event_type")


@query
def daily_mean_last_days(spark, d):
    return settled(last_observed_days(_dated(spark, d), 7))


@query
def trend_last_days(spark, d):
    return settled(R.trend(S.measurements(spark, d), 7, tie=TIE))


@query
def trend_summary(spark, d):
    return settled(R.trend_summary(R.trend(S.measurements(spark, d), 7, tie=TIE)))


@query
def forecast_24(spark, d):
    return seasonal_forecast(S.measurements(spark, d), 24, noise_sd=0, tie=TIE)


@query
def forecast_48(spark, d):
    return seasonal_forecast(S.measurements(spark, d), 48, noise_sd=0, tie=TIE).drop("forecast_time")


@query
def forecast_peak(spark, d):
    return settled(R.forecast_report(S.measurements(spark, d), 24, noise_sd=0, tie=TIE)[1])


@query
def forecast_noisy(spark, d):
    return seasonal_forecast(S.measurements(spark, d), 24, tie=TIE)


# --- reports ------------------------------------------------------------------------------------

@query
def current_quality(spark, d):
    live, past = _live_and_archive(spark, d)
    return settled(R.current_quality(_with_district(spark, d), live, past, tie=TIE))


@query
def compare_sensors(spark, d):
    live, past = _live_and_archive(spark, d)
    return settled(R.compare_sensors(_with_district(spark, d), S.sensors(spark, d).select("sensor_id"), live, past, tie=TIE))


@query
def health_brief(spark, d):
    named = S.sensors(spark, d).select("sensor_id", F.col("district_slug").alias("district"))
    return settled(R.health_brief(S.measurements(spark, d), named, tie=TIE))


@query
def monthly_stats(spark, d):
    return settled(R.monthly_diagram(S.measurements(spark, d), S.sensors(spark, d))["stats"])


@query
def one_sensor_now(spark, d):
    return R.one_sensor_reading(_latest(spark, d), 7).select("sensor_id", "datetime", "pm25")


@query
def sensor_series(spark, d):
    return R.sensor_timeseries(S.measurements(spark, d), 7)["series"]


@query
def sensor_hourly(spark, d):
    return settled(R.sensor_timeseries(S.measurements(spark, d), 7)["hourly"])


@query
def district_comparison_boxes(spark, d):
    boxes = R.district_comparison(S.measurements(spark, d), S.sensors(spark, d), _placed(spark, d), 5)["boxes"]
    return settled(boxes)


@query
def quick_first_points(spark, d):
    return R.quick_analysis(S.measurements(spark, d), S.sensors(spark, d), 300, tie=TIE)["series"]


@query
def personal_advice(spark, d):
    """Advice on the live reading of each sensor, else on the mean of its archive; the source says which."""
    live, past = _live_and_archive(spark, d)
    means = past.groupBy("sensor_id").agg(F.avg("pm25").alias("pm25"))
    current = J.live_or_archive(_customers(spark, d).select("sensor_id"), live, means)
    return settled(R.personal_advice(current))


@query
def clean_whole_frame(spark, d):
    """The original's form: the whole frame is one series."""
    return settled(C.clean_series(S.raw_measurements(spark, d), ts="datetime", keys=(), order=TIE))


# --- the largest table --------------------------------------------------------------------------

@query
def bulk_daily_stats(spark, d):
    return A.daily_sensor_stats(with_calendar(S.bulk_measurements(spark, d)), S.sensors(spark, d), PLACE, min_rows=2)


@query
def bulk_summary(spark, d):
    return settled(A.summary(S.bulk_measurements(spark, d)))


@query
def bulk_histogram(spark, d):
    return settled(D.histogram(S.bulk_measurements(spark, d)))


@query
def bulk_station_mean(spark, d):
    return settled(A.station_means(S.bulk_measurements(spark, d), S.sensors(spark, d)))


@query
def bulk_boxplot(spark, d):
    return settled(D.boxplot_stats(J.attach(S.bulk_measurements(spark, d), S.sensors(spark, d)), ["district_slug"]))


@query
def bulk_resample(spark, d):
    return settled(resample_daily(with_calendar(S.bulk_measurements(spark, d))))


# --- stored partials ----------------------------------------------------------------------------

def _partials(spark, d):
    """Daily partials per sensor, written and read back for eighteen days in the middle."""
    path = fresh_path(spark, "partials")
    P.store_partials(S.measurements(spark, d), path, distinct=["event_type"])
    return P.read_partials(spark, path, "2024-01-06", "2024-01-23")


@query
def partials_per_sensor(spark, d):
    return settled(P.rolled_up(_partials(spark, d), ["sensor_id"]))


@query
def partials_city(spark, d):
    """The whole city; event types are so few that their sketch counts them exactly."""
    return settled(P.rolled_up(_partials(spark, d), distinct=["event_type"]))


# --- streams ------------------------------------------------------------------------------------

def _event_stream(spark, d):
    return L.table_stream(spark, d, "events").select(
        "event_id", F.col("ts").alias("datetime"), F.col("user_id").alias("sensor_id"), F.col("value").alias("pm25"))


@query
def stream_latest(spark, d):
    return L.replay_latest(_event_stream(spark, d), tie=TIE)


@query
def stream_live_or_file(spark, d):
    """Sensors silent for an hour at the end of the stream fall back to the mean of their readings before the last day."""
    _, past = _live_and_archive(spark, d)
    means = past.groupBy("sensor_id").agg(F.avg("pm25").alias("pm25"))
    wanted = _customers(spark, d).select("sensor_id")
    return settled(L.replay_sources(_event_stream(spark, d), wanted, means, idle="1 hour", tie=TIE))


@query
def stream_hourly_averages(spark, d):
    out = L.replay_averages(_event_stream(spark, d), row_id=TIE)
    return settled(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
                      .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


# --- sampling and learning (rows only) ----------------------------------------------------------

@query
def random_sample(spark, d):
    return S.measurements(spark, d).sample(fraction=0.1, seed=7)


@query
def rf_quality(spark, d):
    return quality.model_quality(quality.materialized_features(S.measurements(spark, d)), "random_forest")[0]


@query
def gbt_quality(spark, d):
    return quality.model_quality(quality.materialized_features(S.measurements(spark, d)), "gbt")[0]


@query
def rf_importance(spark, d):
    model = quality.model_quality(quality.materialized_features(S.measurements(spark, d)), "random_forest")[1]
    return learn.feature_importance(spark, model)


def _calendar_tree(spark, d):
    """A tree per sensor on calendar parts, trained before the 24th; and the later readings."""
    m = S.measurements(spark, d).select("sensor_id", "datetime", "pm25", *[f("datetime").cast("double").alias(n) for n, f in (
        ("hour_of_day", F.hour), ("day_of_week", F.dayofweek), ("day_of_month", F.dayofmonth))])
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    levels = {"hour_of_day": range(24), "day_of_week": range(1, 8), "day_of_month": range(1, 32)}
    model = train_keyed(m.where(F.col("datetime") < cut).drop("datetime"), list(levels), kind="tree", depth=3, min_rows=2,
                        levels=levels)
    return model, m.where(F.col("datetime") >= cut)


@query
def sensor_tree_quality(spark, d):
    model, later = _calendar_tree(spark, d)
    return settled(learn.regression_metrics(model.predict(later)))


@query
def sensor_tree_importance(spark, d):
    return settled(_calendar_tree(spark, d)[0].importance())


@query
def sensor_forest_quality(spark, d):
    return quality.per_sensor_quality(quality.materialized_features(S.measurements(spark, d)), "random_forest")[0]


@query
def sensor_boosted_quality(spark, d):
    return quality.per_sensor_quality(quality.materialized_features(S.measurements(spark, d)), "gbt", depth=2)[0]
