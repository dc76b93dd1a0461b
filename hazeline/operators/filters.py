"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazeline.functions import constants as K
from hazeline.operators.joins import attach


def valid_readings(df: DataFrame, value: str = "pm25") -> DataFrame:
    """present, not negative and below the upper limit; reaches the Parquet scan."""
    v = F.col(value)
    return df.where(v.isNotNull() & (v >= K.VALID_MIN) & (v < K.VALID_MAX))


def drop_negative(df: DataFrame, value: str = "pm25", keep_null: bool | None = None) -> DataFrame:
    """drop negative readings.

    By default missing readings go only when some negative one exists, which is what the
    legacy loader does; pass ``keep_null`` to fix the choice and skip that look at the data.
    """
    v = F.col(value)
    if keep_null is None:
        any_negative = df.agg(F.coalesce(F.bool_or(v < 0), F.lit(False))).scalar()
        return df.where((v >= 0) | (v.isNull() & ~any_negative))
    return df.where((v >= 0) | v.isNull() if keep_null else v >= 0)


def only_sensors(df: DataFrame, sensors: Iterable[int] | None, key: str = "sensor_id") -> DataFrame:
    """keep the listed sensors; an empty or missing list keeps all."""
    wanted = list(sensors or ())
    return df.where(F.col(key).isin(wanted)) if wanted else df


def year_span(years) -> tuple[int, int]:
    """first and last year of a period given as one year or as its two ends."""
    ends = [years] if isinstance(years, int) else list(years) if isinstance(years, Sequence) and not isinstance(years, str) else []
    if not 1 <= len(ends) <= 2 or (len(ends) == 1 and not isinstance(years, int)):
        raise ValueError(f"not a year and not a pair of years: {years!r}")
    return ends[0], ends[-1]


def in_months(df: DataFrame, years, months=None) -> DataFrame:
    """predicate on the ``year`` and ``month`` partition columns."""
    first, last = year_span(years)
    out = df.where(F.col("year").between(first, last))
    return out if months is None else out.where(F.col("month").isin(list(months)))


def pm25_parameter_only(df: DataFrame, column: str = "parameter") -> DataFrame:
    """rows of a long-format table that carry PM2.5; a missing parameter is no match."""
    return df.where(F.lower(F.col(column)).rlike("pm25|pm2.5"))


def since(df: DataFrame, as_of, days: int, ts: str = "date") -> DataFrame:
    """rows of the last ``days`` days up to ``as_of`` (a timestamp literal or column), nothing later."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.where((F.col(ts) >= end - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= end))


def min_count(df: DataFrame, n: int, column: str = "measurements_count") -> DataFrame:
    """groups with at least ``n`` rows."""
    return df.where(F.col(column) >= n)


def allow_listed(df: DataFrame, allowed: DataFrame, on: str = "sensor_id", fixed_size: bool = False) -> DataFrame:
    """Keep rows whose key is in ``allowed``.

    ``fixed_size`` says that the list is bounded by construction, such as a top-n; any other list is
    measured before it is broadcast.
    """
    if fixed_size:
        return df.join(F.broadcast(allowed.select(on)), on, "left_semi")
    return attach(df, allowed.select(on).distinct(), on, "inner").select(*df.columns)


def flag_exceedance(df: DataFrame, value: str = "pm25") -> DataFrame:
    """row flags against the annual guideline and the high threshold; missing counts as false."""
    v = F.col(value)
    return (df.withColumn("above_guideline", F.coalesce(v > K.GUIDELINE_ANNUAL, F.lit(False)))
              .withColumn("hazardous", F.coalesce(v > K.GUIDELINE_HIGH, F.lit(False))))
