"""Naive seasonal forecast (M1, M2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazeline.functions.numeric import hash_normal, round_stable
from hazeline.functions.risk import risk_band
from hazeline.operators.latest import latest_n

HISTORY = 24
NOISE_SD = 0.05
DECAY = 0.95


def seasonal_forecast(df: DataFrame, hours: int = 24, noise_sd: float = NOISE_SD, seed: int = 7,
                      ts: str = "datetime", tie: Sequence[str] = (), value: str = "pm25",
                      key: str = "sensor_id") -> DataFrame:
    """M1 + M2: repeat the last 24 readings with noise, then decay towards their mean.

    Step i < 24 is the i-th of the last 24 readings times (1 + noise); later steps are 0.95 of the
    previous forecast plus 0.05 of the mean. Every step is rounded to one decimal and not below zero,
    and the next step starts from the rounded value. Sensors with fewer than 24 readings get none.
    ``hours`` is clamped to 1..48. Times count from the sensor's last reading.
    """
    hours = min(max(hours, 1), 48)
    recent = latest_n(df.select(key, ts, *tie, value).where(F.col(value).isNotNull()), HISTORY, ts, tie, (key,))
    # 24 entries at most per sensor
    history = (recent.groupBy(key)
               .agg(F.sort_array(F.collect_list(F.struct(ts, *tie, F.col(value).cast("double").alias("_v")))).alias("_h"),
                    F.max(ts).alias("_last"))
               .where(F.size("_h") == HISTORY)
               .select(key, "_last", F.col("_h._v").alias("_h"))
               .withColumn("_mean", F.aggregate("_h", F.lit(0.0), lambda a, x: a + x) / HISTORY))

    def step(x):
        return F.greatest(F.lit(0.0), round_stable(x, 1))

    def seasonal(x, i):
        noise = F.lit(noise_sd) * hash_normal(seed, F.col(key), i) if noise_sd else F.lit(0.0)
        return step(x * (1 + noise))

    repeated = history.withColumn("_f", F.transform("_h", seasonal))
    if hours > HISTORY:
        later = F.aggregate(
            F.sequence(F.lit(HISTORY), F.lit(hours - 1)), F.col("_f"),
            lambda acc, _: F.array_append(acc, step(F.element_at(acc, -1) * DECAY + F.col("_mean") * (1 - DECAY))))
        repeated = repeated.withColumn("_f", later)
    steps = repeated.select(key, "_last", F.posexplode(F.slice("_f", 1, hours)).alias("_i", "forecast"))
    return steps.select(
        key, (F.col("_i") + 1).alias("step"),
        (F.col("_last") + F.make_dt_interval(hours=F.col("_i") + 1)).alias("forecast_time"),
        "forecast", risk_band(F.col("forecast")).alias("risk_level"))
