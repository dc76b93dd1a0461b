"""Grouped and global statistics.

Statistics by an attribute of the sensor are first reduced per sensor and only then joined to the
metadata, so the join and the final grouping handle one row per sensor whatever the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazeline.functions import constants as K
from hazeline.functions.numeric import round_stable
from hazeline.functions.risk import district_display_name
from hazeline.operators.quantiles import one_row, quantiles


def _rounded(col: Column, digits: int | None) -> Column:
    return col if digits is None else round_stable(col, digits)


def _moments(value: str) -> list[Column]:
    """Mergeable summary of a group: size, mean, sum of squared deviations, range."""
    v = F.col(value)
    return [F.count(v).alias("_n"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count(v)).alias("_ssd"),
            F.min(v).alias("_min"), F.max(v).alias("_max")]


def _sample_std(ssd: Column, n: Column) -> Column:
    """Sample deviation; NULL for a single row."""
    return F.when(n > 1, F.sqrt(F.greatest(ssd, F.lit(0.0)) / (n - 1)))


def daily_sensor_stats(df: DataFrame, sensors: DataFrame | None = None, location: Sequence[str] = (),
                       min_rows: int = 18, digits: int | None = 2, value: str = "pm25",
                       key: str = "sensor_id", day: str = "date") -> DataFrame:
    """A1 + F7: daily mean, deviation, range and count per sensor and place.

    Groups with a missing key drop out, so readings of sensors without metadata vanish. Should a
    sensor appear several times in the metadata with the same place, each copy counts its readings
    again, exactly as joining first would.
    """
    daily = df.dropna(subset=[day, key]).groupBy(day, key).agg(*_moments(value))
    keys = [day, key]
    copies = F.lit(1)
    if sensors is not None:
        places = (sensors.dropna(subset=[key, *location]).groupBy(key, *location)
                         .agg(F.count(F.lit(1)).alias("_copies")))
        daily = daily.join(places, key)
        keys += list(location)
        copies = F.col("_copies")
    n = F.col("_n") * copies
    return daily.where(n >= min_rows).select(
        *keys,
        _rounded(F.col("_mean"), digits).alias(f"{value}_mean"),
        _rounded(_sample_std(F.col("_ssd") * copies, n), digits).alias(f"{value}_std"),
        _rounded(F.col("_min"), digits).alias(f"{value}_min"),
        _rounded(F.col("_max"), digits).alias(f"{value}_max"),
        n.alias("measurements_count"),
    )


def grouped_stats(df: DataFrame, keys: Sequence[str], min_rows: int = 0, digits: int | None = None,
                  value: str = "pm25") -> DataFrame:
    """A1 without metadata: mean, deviation, range and count by any columns present on the rows."""
    v = F.col(value)
    return (df.dropna(subset=list(keys)).groupBy(*keys)
              .agg(_rounded(F.avg(v), digits).alias(f"{value}_mean"),
                   _rounded(F.stddev_samp(v), digits).alias(f"{value}_std"),
                   _rounded(F.min(v), digits).alias(f"{value}_min"),
                   _rounded(F.max(v), digits).alias(f"{value}_max"),
                   F.count(v).alias("measurements_count"))
              .where(F.col("measurements_count") >= min_rows))


def daily_mean(df: DataFrame, keys: Sequence[str] = (), value: str = "pm25", day: str = "date") -> DataFrame:
    """A2/A3: mean per day, optionally per key."""
    return df.dropna(subset=[*keys, day]).groupBy(*keys, day).agg(F.avg(value).alias(f"{value}_mean"))


def hourly_profile(df: DataFrame, keys: Sequence[str] = (), value: str = "pm25", hour: str = "hour") -> DataFrame:
    """A4: mean and deviation by hour of day with the band mean +- deviation."""
    out = df.dropna(subset=[*keys, hour]).groupBy(*keys, hour).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"))
    mean, std = F.col(f"{value}_mean"), F.col(f"{value}_std")
    return out.withColumn(f"{value}_lower", mean - std).withColumn(f"{value}_upper", mean + std)


def by_sensor_attribute(df: DataFrame, sensors: DataFrame, keys: Sequence[str], value: str = "pm25",
                        key: str = "sensor_id") -> DataFrame:
    """Mean, deviation and count by metadata columns (A5-A8), from per-sensor moments."""
    per_sensor = df.dropna(subset=[key]).groupBy(key).agg(*_moments(value))
    attributes = sensors.select(*dict.fromkeys([key, *keys])).dropna(subset=list(keys))
    n, mean = F.col("_n"), F.col("_mean")
    merged = per_sensor.join(attributes, key).groupBy(*keys).agg(
        F.sum(n).alias("count"),
        (F.sum(n * mean) / F.sum(n)).alias("mean"),
        (F.sum(F.col("_ssd")) + F.sum(n * mean * mean)
         - F.sum(n * mean) * F.sum(n * mean) / F.sum(n)).alias("_dev"),
    )
    return merged.select(*keys, "mean", _sample_std(F.col("_dev"), F.col("count")).alias("std"), "count")


def district_stats(df: DataFrame, sensors: DataFrame, top_n: int | None = 10, digits: int | None = 2,
                   district: str = "district_slug") -> DataFrame:
    """A5: mean, deviation and count per district, highest rounded mean first."""
    stats = by_sensor_attribute(df, sensors, [district]).select(
        district, _rounded(F.col("mean"), digits).alias("mean"), _rounded(F.col("std"), digits).alias("std"), "count")
    return top(stats, "mean", district, top_n)


def district_means(df: DataFrame, sensors: DataFrame, top_n: int | None = 8,
                   district: str = "district_slug") -> DataFrame:
    """Unrounded mean per displayed district name, highest first."""
    named = sensors.withColumn("district", district_display_name(F.col(district)))
    return top(by_sensor_attribute(df, named, ["district"]).select("district", "mean"), "mean", "district", top_n)


def station_means(df: DataFrame, sensors: DataFrame, station: str = "station_id") -> DataFrame:
    """Mean per station, lowest first."""
    return by_sensor_attribute(df, sensors, [station]).select(station, "mean").orderBy("mean", station)


def location_means(df: DataFrame, sensors: DataFrame, location: Sequence[str] = ("latitude", "longitude"),
                   key: str = "sensor_id") -> DataFrame:
    """Mean per sensor and place."""
    return by_sensor_attribute(df, sensors, [key, *location]).select(key, *location, "mean")


def summary(df: DataFrame, value: str = "pm25", percents: Sequence[int] = K.PERCENTILES,
            approx: bool = False) -> DataFrame:
    """A9 + A10: one row over non-negative readings, with median and the listed percentiles."""
    v = F.col(value)
    known = df.where(v >= 0)
    probs = {"median": 0.5, **{f"p{p}": p / 100 for p in percents}}
    basic = known.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                      F.min(v).alias("min"), F.max(v).alias("max"))
    spots = one_row(quantiles(known, value, probs, approx=approx))
    return basic.withColumn("_q", spots).select("*", "_q.*").drop("_q")


def describe(df: DataFrame, value: str = "pm25", keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, range and quartiles; one row, or one per key."""
    v = F.col(value)
    src = df.dropna(subset=list(keys)) if keys else df
    basic = src.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                                   F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    spots = quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys)
    if keys:
        return basic.join(spots, list(keys), "left")
    return basic.withColumn("_q", one_row(spots)).select("*", "_q.*").drop("_q")


def share_percent(flag: Column) -> Column:
    """Share of rows meeting a condition in percent; a missing value is a no."""
    return F.avg(F.coalesce(flag.cast("double"), F.lit(0.0))) * 100


def exceedance(df: DataFrame, keys: Sequence[str] = (), value: str = "pm25", digits: int | None = 1) -> DataFrame:
    """Share of readings above the guideline and above the high threshold."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        _rounded(share_percent(v > K.GUIDELINE_ANNUAL), digits).alias("pct_above_guideline"),
        _rounded(share_percent(v > K.GUIDELINE_HIGH), digits).alias("pct_hazardous"),
        F.count(F.lit(1)).alias("data_points"))


def rows_per_sensor(df: DataFrame, top_n: int | None = 10, key: str = "sensor_id") -> DataFrame:
    """A13 + T2: row counts per sensor, most rows first."""
    return top(df.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("measurements")),
               "measurements", key, top_n)


def top_by_mean(df: DataFrame, n: int = 5, value: str = "pm25", key: str = "sensor_id") -> DataFrame:
    """The ``n`` sensors with the highest mean, lower id first on ties."""
    means = df.dropna(subset=[key]).groupBy(key).agg(F.avg(value).alias("mean"))
    return top(means.where(F.col("mean").isNotNull()), "mean", key, n)


def distinct_and_range(df: DataFrame, columns: Sequence[str], ts: str = "datetime", approx: bool = False) -> DataFrame:
    """A14 + A15: distinct counts of ``columns`` and the time range, in one row.

    Exact counts reduce each column to its distinct values first; several columns in one aggregate
    would make Spark expand every row once per column.
    """
    span = df.agg(F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))
    for name in columns:
        if approx:
            counted = df.agg(F.approx_count_distinct(name).alias("n"))
        else:
            counted = df.select(name).distinct().agg(F.count(name).alias("n"))
        span = span.withColumn(f"distinct_{name}", counted.scalar())
    return span


def data_quality(df: DataFrame, value: str = "pm25", digits: int | None = 1) -> DataFrame:
    """Total, missing and negative readings with percentages, one pass."""
    v, total = F.col(value), F.count(F.lit(1))
    missing, negative = F.count_if(v.isNull()), F.count_if(v < 0)
    return df.agg(total.alias("total_rows"),
                  missing.alias("missing"), _rounded(missing / total * 100, digits).alias("missing_pct"),
                  negative.alias("negative"), _rounded(negative / total * 100, digits).alias("negative_pct"))


def live_summary(latest: DataFrame, value: str = "pm25", skip_zero: bool = True) -> DataFrame:
    """Average, range and number of current readings; zero is treated as no reading by default."""
    v = F.col(value)
    used = latest.where(v != 0 if skip_zero else v.isNotNull())
    return used.agg(F.avg(v).alias("avg_pm25"), F.max(v).alias("max_pm25"), F.min(v).alias("min_pm25"),
                    F.count(v).alias("sensor_count"))


def sensors_by_district(sensors: DataFrame, district: str = "district", key: str = "sensor_id") -> DataFrame:
    """The sensor list as one row per sensor with the size of its district and the overall total.

    Long form keeps a district of any size out of a single array; sort by (district, sensor) to print.
    """
    known = sensors.dropna(subset=[district]).select(district, key)
    sizes = known.groupBy(district).agg(F.count(F.lit(1)).alias("sensors_in_district"))
    total = known.agg(F.count(F.lit(1))).scalar()
    return known.join(sizes, district).withColumn("total_sensors", total)


def mean_and_peak(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Second-level mean and maximum of forecast steps or daily means."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"))


def top(df: DataFrame, by: str, tie: str, n: int | None) -> DataFrame:
    """Highest first with an explicit second key; ``n`` of None keeps all, sorted."""
    ordered = df.orderBy(F.desc(by), F.asc(tie))
    return ordered if n is None else ordered.limit(n)


def in_time_order(df: DataFrame, ts: str, *tie: str) -> DataFrame:
    """Global order by time, for outputs whose product is the order."""
    return df.orderBy(ts, *tie)
