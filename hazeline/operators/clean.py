"""Cleaning of raw readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from hazeline.functions.columns import detect_value_column
from hazeline.operators.joins import attach
from hazeline.operators.quantiles import one_row, quantiles
from hazeline.operators.series import fill_gaps
from hazeline.session import materialized

OUTLIER_METHODS = ("iqr", "zscore")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicates; missing values compare equal."""
    return df.dropDuplicates()


def basic_clean(df: DataFrame, value: str | None = None, day: str = "date", drop_copies: bool = True) -> DataFrame:
    """Distinct rows, negative readings to missing, time column parsed.

    The row order of the original is not kept: later steps order inside their own windows.
    """
    value = value or detect_value_column(df)
    out = distinct_rows(df) if drop_copies else df
    if value in df.columns:
        v = F.col(f"`{value}`")
        out = out.withColumn(value, F.when(~(v < 0), v))
    if day in df.columns and dict(df.dtypes)[day] == "string":
        out = out.withColumn(day, F.col(day).cast("timestamp"))
    return out


def _outlier_flag(df: DataFrame, value: str, method: str, threshold: float,
                  keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The frame with what the test needs and the test itself (NULL for a missing reading)."""
    v = F.col(value)
    if method == "iqr":
        limits = quantiles(df, value, {"q1": 0.25, "q3": 0.75}, keys)
        margin = F.lit(float(threshold)) * (F.col("q3") - F.col("q1"))
        limits = limits.select(*keys, (F.col("q1") - margin).alias("lo"), (F.col("q3") + margin).alias("hi"))
        names = ("lo", "hi")
        test = (v < F.col("_lim.lo")) | (v > F.col("_lim.hi"))
    elif method == "zscore":
        src = df.dropna(subset=list(keys)) if keys else df
        limits = src.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
        names = ("mean", "sd")
        test = F.when(F.col("_lim.sd") > 0,
                      F.abs((v - F.col("_lim.mean")) / F.col("_lim.sd")) > threshold).otherwise(F.lit(False))
    else:
        raise ValueError(f"unknown outlier method: {method}; expected one of {OUTLIER_METHODS}")
    if not keys:
        return df.withColumn("_lim", one_row(limits)), test
    # one row per key, written once: its size is then measured without computing it again
    per_key = materialized(limits.select(*keys, F.struct(*names).alias("_lim")), "limits")
    return attach(df, per_key, keys), test


def outliers_to_null(df: DataFrame, value: str = "pm25", method: str = "iqr", threshold: float = 3.0,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Readings outside the fence become missing; global limits by default, per key on request.

    iqr: below Q1 - k*IQR or above Q3 + k*IQR, strictly; zscore: |z| > k with the population deviation.
    """
    tested, flag = _outlier_flag(df, value, method, threshold, keys)
    return tested.withColumn(value, F.when(~F.coalesce(flag, F.lit(False)), F.col(value))).select(*df.columns)


class CleaningLog:
    """What each step of ``clean_series`` changed, counted by the very run that cleans.

    Pass one to ``clean_series``. Duplicates and negatives are counted while the distinct rows are written, outliers and
    gaps by whatever action runs the cleaned frame first; ask for the log after that, or it waits.
    """

    STEPS = ("duplicates_removed", "negatives_to_null", "outliers_to_null", "gaps_filled")

    def __init__(self):
        self.distinct, self.filled = Observation(), Observation()

    def frame(self, spark: SparkSession) -> DataFrame:
        """(step_no, step, rows), four rows."""
        counts = {**self.distinct.get, **self.filled.get}
        return spark.createDataFrame([(i, s, int(counts.get(s) or 0)) for i, s in enumerate(self.STEPS, 1)],
                                     "step_no int, step string, rows long")


def _distinct_rows(df: DataFrame, value: str, ts: str, log: CleaningLog | None) -> DataFrame:
    """The rows of ``basic_clean``, written once."""
    if log is None:
        return materialized(basic_clean(df, value, ts), "distinct")
    v = F.col(value)
    once = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    seen = once.observe(log.distinct, F.sum(F.col("_copies") - 1).alias("duplicates_removed"),
                        F.count_if(v < 0).alias("negatives_to_null"))
    return materialized(basic_clean(seen.drop("_copies"), value, ts, drop_copies=False), "distinct")


def clean_series(df: DataFrame, value: str | None = None, ts: str = "date", keys: Sequence[str] = ("sensor_id",),
                 order: Sequence[str] = (), remove_outliers: bool = True, handle_missing: bool = True,
                 outlier_method: str = "iqr", missing_method: str = "interpolate_time",
                 log: CleaningLog | None = None) -> DataFrame:
    """Basic clean, then outliers at k=3, then gaps at limit 7; the last two can be switched off.

    The distinct rows are written to the shared folder once: limits and gap filling read them several
    times, and without that each reading would repeat the shuffle that removes duplicates. ``log`` is filled on the way.
    """
    value = value or detect_value_column(df)
    v = F.col(value)
    if not (remove_outliers or handle_missing or log):
        return basic_clean(df, value, ts)
    out = _distinct_rows(df, value, ts, log)
    if log is not None:
        out = out.withColumn("_known", v.isNotNull())
    if remove_outliers:
        out = outliers_to_null(out, value, outlier_method)
    if log is not None:
        out = out.withColumn("_outlier", F.col("_known") & v.isNull()).withColumn("_gap", v.isNull())
    if handle_missing:
        out = fill_gaps(out, value, ts, keys, order, missing_method)
    if log is None:
        return out
    return out.observe(log.filled, F.count_if("_outlier").alias("outliers_to_null"),
                       F.count_if(F.col("_gap") & v.isNotNull()).alias("gaps_filled")).drop("_known", "_outlier", "_gap")


def cleaning_log(df: DataFrame, **options) -> DataFrame:
    """Clean, write what comes out, and tell what each step changed: (step_no, step, rows)."""
    log = CleaningLog()
    materialized(clean_series(df, log=log, **options), "cleaned")
    return log.frame(df.sparkSession)


def cleaning_summary(log: DataFrame) -> DataFrame:
    """C6 as text lines: the steps that changed something."""
    return log.where(F.col("rows") > 0).select(
        "step_no", F.format_string("%d. %s: %d rows", "step_no", "step", "rows").alias("text"))
