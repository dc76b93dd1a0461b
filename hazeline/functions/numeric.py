"""Numeric and time helpers built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def round_stable(col: Column, digits: int) -> Column:
    """Round half up, after a nudge in the last few of a double's sixteen digits.

    An average that should sit exactly on a tie carries summation noise that depends on
    how rows were partitioned; a nudge of 1e-12 of the value sends all of those the same way and is too small to
    move any other value that is given with a dozen digits. From 2^52 steps on a double has
    no digits left to round and stays as it is; NaN is missing.
    """
    scale = float(10**digits)
    steps = col.cast("double") * F.lit(scale)
    rounded = (F.floor(steps + F.lit(0.5) + F.abs(steps) * F.lit(1e-12)) / F.lit(scale)).cast("double")
    return F.when(F.isnan(steps), None).when(F.abs(steps) < F.lit(float(1 << 52)), rounded).otherwise(col.cast("double"))


def null_if_nan(col: Column) -> Column:
    """Missing is always NULL, never NaN."""
    return F.when(~F.isnan(col), col)


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, NTZ timestamp or date column.

    Under UTC an NTZ value and the instant are the same number. In any other session time zone NTZ
    values are taken apart field by field, so that changes of the clock never shift them.
    """
    kind = df.schema[ts].dataType
    col = F.col(f"`{ts}`")
    utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
    if isinstance(kind, T.TimestampType) or (utc and isinstance(kind, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    days = F.unix_date(F.to_date(col)).cast("long") * F.lit(DAY_US)
    if isinstance(kind, T.DateType):
        return days
    seconds = F.extract(F.lit("SECOND"), col).cast("decimal(8,6)") * F.lit(1_000_000)
    return (days + F.hour(col).cast("long") * F.lit(HOUR_US)
            + F.minute(col).cast("long") * F.lit(60_000_000) + seconds.cast("long"))


def floor_div(col: Column, width: int) -> Column:
    """Floor division of a long column by a constant, also right for negatives."""
    width_col = F.lit(width).cast("long")
    return F.call_function("div", col - F.pmod(col, width_col), width_col)


def hash_normal(seed: int, *cols: Column) -> Column:
    """Standard normal noise that depends only on its inputs (Box-Muller on two hashes).

    A re-run task gives the same numbers, unlike ``randn``, whose stream follows the partition.
    """
    span = 1 << 53
    u1 = (F.pmod(F.xxhash64(F.lit("radius"), F.lit(seed), *cols), F.lit(span)) + 1) / F.lit(float(span))
    u2 = F.pmod(F.xxhash64(F.lit("angle"), F.lit(seed), *cols), F.lit(span)) / F.lit(float(span))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
