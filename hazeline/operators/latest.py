"""Latest readings (W1-W4) and first rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hazeline.operators.aggregate import daily_mean


def latest_snapshot(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Every row at the overall latest time; the maximum is pushed into the scan as a filter.

    Without a time column the table is taken as already latest.
    """
    return df.where(F.col(ts) == df.agg(F.max(ts)).scalar()) if ts in df.columns else df


def as_readings(df: DataFrame, source: str, file_time: str | None = None, ts: str = "datetime") -> DataFrame:
    """The record shape of a current reading: id, value, time, origin and any weather columns present."""
    extra = [c for c in ("temperature", "humidity", "pressure") if c in df.columns]
    return df.select("sensor_id", "pm25", F.col(ts).alias("timestamp"), F.lit(source).alias("source"),
                     F.lit(file_time).cast("string").alias("file_time"), *extra)


def latest_per_sensor(df: DataFrame, ts: str = "datetime", tie: Sequence[str] = (), keys: Sequence[str] = ("sensor_id",),
                      skip_falsy_keys: bool = False) -> DataFrame:
    """Newest row of each sensor, a mergeable aggregate, so a busy sensor is reduced where it is read.

    ``skip_falsy_keys`` leaves out sensor 0 like the original lookup table does.
    """
    rest = [c for c in df.columns if c not in keys]
    src = df.dropna(subset=list(keys))
    if skip_falsy_keys:
        for k in keys:
            src = src.where(F.col(k) != 0)
    newest = F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_row")
    return src.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def latest_n(df: DataFrame, n: int = 24, ts: str = "datetime", tie: Sequence[str] = (),
             keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """The ``n`` newest rows per sensor; each task sends at most ``n`` rows of a sensor on."""
    order = W.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(c) for c in tie])
    return (df.dropna(subset=list(keys)).withColumn("_rn", F.row_number().over(order))
              .where(F.col("_rn") <= n).drop("_rn"))


def last_observed_days(df: DataFrame, days: int = 7, keys: Sequence[str] = ("sensor_id",), value: str = "pm25",
                       day: str = "date") -> DataFrame:
    """A3 + W4: daily means of the last ``days`` days that have data."""
    means = daily_mean(df, keys, value, day)
    order = W.partitionBy(*keys).orderBy(F.desc(day))
    return means.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= days).drop("_rn")


def first_n_per_group(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order, merged map-side (missing keys form one group)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)
