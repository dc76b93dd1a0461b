"""The questions users ask, composed from the operators (Q1-Q18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazeline.functions import constants as K
from hazeline.functions.columns import with_calendar
from hazeline.functions.risk import (
    excess_percent, excess_risk_columns, profile_advice, recommendation, risk_band, risk_message,
)
from hazeline.operators import aggregate as A, distribution as D
from hazeline.operators.filters import allow_listed
from hazeline.operators.forecast import seasonal_forecast
from hazeline.operators.health import health_rollup, health_summary
from hazeline.operators.joins import live_or_archive
from hazeline.operators.latest import last_observed_days, latest_n, latest_per_sensor
from hazeline.operators.quantiles import one_row
from hazeline.operators.series import resample_daily

RULE = "=" * 70
MEAN = "pm25"


def known_sensors(spark: SparkSession) -> DataFrame:
    """The built-in allow-list with districts (13 rows)."""
    return spark.createDataFrame(sorted(K.SENSOR_DISTRICTS.items()), "sensor_id long, district string")


def current_quality(requested: DataFrame, live: DataFrame, archive: DataFrame, ts: str = "datetime",
                    tie: Sequence[str] = ()) -> DataFrame:
    """Q1: value, band, risks, recommendation and city summary for every requested sensor.

    A sensor without a live row gets its newest archive row. ``requested`` may carry a district; the time of the
    value is given where the live rows have one.
    """
    newest = latest_per_sensor(archive.select("sensor_id", ts, *tie, MEAN), ts, tie)
    found = live_or_archive(requested, live, newest, carry=[ts] if ts in live.columns else [])
    v = F.col(MEAN)
    out = found.select(*found.columns, risk_band(v).alias("risk_level"), risk_message(v).alias("risk_message"),
                       *excess_risk_columns(v), recommendation(v).alias("recommendation"))
    return out.withColumn("_city", one_row(A.live_summary(live))).select("*", "_city.*").drop("_city")


def one_sensor_reading(latest: DataFrame, sensor_id: int) -> DataFrame:
    """Q18: the current reading of one sensor."""
    return latest.where(F.col("sensor_id") == sensor_id)


def forecast_report(df: DataFrame, hours: int = 24, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Q2: the forecast steps and their peak and average per sensor (the first 12 steps are usually shown)."""
    steps = seasonal_forecast(df, hours, **kwargs)
    return steps, A.mean_and_peak(steps, "forecast", ["sensor_id"])


def compare_sensors(requested: DataFrame, allowed: DataFrame, live: DataFrame, archive: DataFrame, recent: int = 24,
                    ts: str = "datetime", tie: Sequence[str] = ()) -> DataFrame:
    """Q3: allowed sensors side by side, live value or mean of the last readings, highest first."""
    past = latest_n(archive.select("sensor_id", ts, *tie, MEAN), recent, ts, tie)
    means = past.groupBy("sensor_id").agg(F.avg(MEAN).alias(MEAN))
    wanted = allow_listed(requested, allowed)
    out = live_or_archive(wanted, live, means)
    return out.withColumn("risk_level", risk_band(F.col(MEAN))).orderBy(F.desc(MEAN), "sensor_id")


def health_brief(df: DataFrame, allowed: DataFrame, recent: int = 720, ts: str = "datetime",
                 tie: Sequence[str] = ()) -> DataFrame:
    """Q4: mean of the last readings per allowed sensor, its band and excess mortality."""
    past = latest_n(allow_listed(df.select("sensor_id", ts, *tie, MEAN), allowed), recent, ts, tie)
    means = past.groupBy("sensor_id").agg(F.avg(MEAN).alias("mean"))
    v = F.col("mean")
    mortality = next(c for name, c, _ in K.RISK_COEFFICIENTS if name == "mortality")
    named = allowed.select("sensor_id", "district")
    return means.join(named, "sensor_id").select(
        "sensor_id", "district", "mean", risk_band(v).alias("risk_level"),
        excess_percent(v, mortality).alias("mortality_excess_pct"))


def health_brief_lines(brief: DataFrame, title: str = "AIR QUALITY HEALTH REPORT") -> DataFrame:
    """Report lines (section, line_no, text); section 0 is the heading."""
    body = brief.select(
        F.col("sensor_id").cast("long").alias("section"), F.lit(1).alias("line_no"),
        F.format_string("Sensor %d (%s): %.1f µg/m³ - %s", "sensor_id", "district", "mean", "risk_level").alias("text"))
    return _heading(brief.sparkSession, [title, "=" * 40, ""]).unionByName(body)


def _heading(spark: SparkSession, texts: Sequence[str], section: int = -1) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(texts)],
                                 "section long, line_no int, text string")


def trend(df: DataFrame, days: int = 7, min_rows: int = 24, ts: str = "datetime", tie: Sequence[str] = ()) -> DataFrame:
    """Q5: daily means of the last observed days with their band; sensors with too few readings drop out.

    As in the original, only the newest ``days * 24`` readings of a sensor are looked at.
    """
    days = min(days, 30)
    past = with_calendar(latest_n(df.select("sensor_id", ts, *tie, MEAN), days * 24, ts, tie), ts)
    enough = past.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    daily = last_observed_days(past, days)
    return (daily.join(enough.select("sensor_id"), "sensor_id", "left_semi")
                 .withColumn("risk_level", risk_band(F.col("pm25_mean"))))


def trend_summary(daily: DataFrame) -> DataFrame:
    """Average and peak of the trend's daily means."""
    return A.mean_and_peak(daily, "pm25_mean", ["sensor_id"])


def personal_advice(current: DataFrame, profiles: Sequence[str] = tuple(K.PROFILE_ADVICE)) -> DataFrame:
    """Q6: advice for each current reading and profile (four profiles)."""
    v = F.col(MEAN)
    wide = current.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles])))
    return wide.withColumn("risk_level", risk_band(v)).withColumn("advice", profile_advice(F.col("profile"), v))


def monthly_diagram(df: DataFrame, sensors: DataFrame, ts: str = "datetime", bins: int = 50) -> dict[str, DataFrame]:
    """Q7: the data behind the monthly diagram and its statistics, for whatever period ``df`` covers."""
    timed = with_calendar(df, ts)
    v = F.col(MEAN)
    stats = df.agg(F.count(F.lit(1)).alias("measurements"), F.avg(v).alias("mean"), F.max(v).alias("max"),
                   A.share_percent(v > K.GUIDELINE_ANNUAL).alias("pct_above_guideline"))
    return {"daily": A.daily_mean(timed), "histogram": D.histogram(df, MEAN, bins), "hourly": A.hourly_profile(timed),
            "districts": A.district_means(df, sensors), "summary": A.summary(df), "stats": stats}


def sensor_listing(sensors: DataFrame, district: str = "district") -> DataFrame:
    """Q8: sensors in print order, with district sizes and the total."""
    return A.sensors_by_district(sensors, district).orderBy(district, "sensor_id")


def _risk_lines() -> Column:
    """Text lines of the excess risks of one sensor, none at or below the guideline."""
    return F.flatten(F.transform("excess_health_risks", lambda r: F.array(
        F.concat(F.lit("    "), F.initcap(F.replace(r["outcome"], F.lit("_"), F.lit(" "))), F.lit(":")),
        F.concat(F.lit("      Relative Risk: "), r["relative_risk"].cast("string")),
        F.concat(F.lit("      Excess Risk: "), r["excess_risk_percent"].cast("string"), F.lit("%")))))


def health_report(df: DataFrame, sensors: DataFrame, location: Sequence[str] = (), district: str = "district_slug",
                  population: int = 1_000_000) -> dict[str, DataFrame]:
    """Q10: per-sensor summary, population impact and report lines from one pass over the readings."""
    summary = health_summary(df, sensors, [district, *location])
    summary = summary.withColumn(district, F.coalesce(district, F.lit("Unknown")))
    head = _heading(df.sparkSession, [
        RULE, "HEALTH RISK ASSESSMENT REPORT", RULE, "",
        f"WHO Annual Guideline: {K.GUIDELINE_ANNUAL:g} µg/m³", f"WHO 24-hour Guideline: {K.GUIDELINE_24H:g} µg/m³", ""])
    fixed = F.array(
        F.lit(""), F.format_string(f"Sensor %d (%s):", "sensor_id", district),
        F.concat(F.lit("  Mean PM2.5: "), F.col("mean_pm25").cast("string"), F.lit(" µg/m³")),
        F.concat(F.lit("  Max PM2.5: "), F.col("max_pm25").cast("string"), F.lit(" µg/m³")),
        F.concat(F.lit("  Air Quality: "), F.col("air_quality_category")),
        F.concat(F.lit("  % Above WHO: "), F.col("percent_above_guideline").cast("string"), F.lit("%")), F.lit(""))
    risks = F.when(F.size("excess_health_risks") > 0,
                   F.concat(F.array(F.lit("  Excess Health Risks:")), _risk_lines())).otherwise(F.array().cast("array<string>"))
    body = summary.select(F.col("sensor_id").cast("long").alias("section"),
                          F.posexplode(F.concat(fixed, risks)).alias("line_no", "text"))
    tail = _heading(df.sparkSession, ["", RULE], section=(1 << 63) - 1)
    return {"summary": summary, "impact": health_rollup(summary, population),
            "lines": head.unionByName(body).unionByName(tail)}


def sensor_timeseries(df: DataFrame, sensor_id: int, ts: str = "datetime") -> dict[str, DataFrame]:
    """Q11: readings of one sensor in time order and its hourly profile."""
    own = with_calendar(df.where(F.col("sensor_id") == sensor_id), ts)
    return {"series": own.select(ts, MEAN).orderBy(ts), "hourly": A.hourly_profile(own)}


def district_comparison(df: DataFrame, sensors: DataFrame, joined: DataFrame, top_n: int = 10,
                        district: str = "district_slug") -> dict[str, DataFrame]:
    """Q12: the worst districts and their box-plot statistics; ``joined`` is ``df`` with the district attached."""
    worst = A.district_stats(df, sensors, top_n, district=district)
    boxes = D.boxplot_stats(joined, [district]).join(worst.select(district), district, "left_semi")
    return {"districts": worst, "boxes": boxes}


def dashboard(df: DataFrame, ts: str = "datetime") -> dict[str, DataFrame]:
    """Q13: city daily means, distribution and the marked mean and median."""
    return {"daily": A.daily_mean(with_calendar(df, ts)), "histogram": D.histogram(df), "summary": A.summary(df)}


def quick_analysis(df: DataFrame, sensors: DataFrame, first_points: int = 1000, ts: str = "datetime",
                   tie: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Q14: metadata head, statistics, busiest sensors, first points of the series, histogram and data quality."""
    return {"sensors": sensors.orderBy("sensor_id").limit(3), "summary": A.summary(df),
            "busiest": A.rows_per_sensor(df), "series": df.orderBy(ts, *tie).limit(first_points),
            "histogram": D.histogram(df.where(F.col(MEAN) >= 0)), "quality": A.data_quality(df)}


def exploration(df: DataFrame, sensors: DataFrame, location: Sequence[str] = ("latitude", "longitude"),
                ts: str = "datetime") -> dict[str, DataFrame]:
    """Q15: range and counts, description, station and place means, daily series of the five highest sensors."""
    highest = A.top_by_mean(df, 5)
    daily = resample_daily(with_calendar(allow_listed(df, highest, fixed_size=True), ts))
    return {"range": A.distinct_and_range(df, ["sensor_id"], ts), "describe": A.describe(df),
            "stations": A.station_means(df, sensors), "places": A.location_means(df, sensors, location),
            "highest": highest, "daily": daily}
