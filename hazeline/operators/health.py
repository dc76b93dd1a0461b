"""Health summary per sensor and its roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazeline.functions import constants as K
from hazeline.functions.numeric import round_stable
from hazeline.functions.risk import estimator_category, excess_risk_entries, population_impact_columns
from hazeline.operators.aggregate import share_percent
from hazeline.operators.latest import keep_first


def health_summary(df: DataFrame, sensors: DataFrame | None = None, location: Sequence[str] = (),
                   value: str = "pm25", key: str = "sensor_id") -> DataFrame:
    """One row per sensor that has readings, for whatever period ``df`` covers.

    Category and risks follow from the unrounded mean; the place is looked up after aggregation.
    """
    v = F.col(value)
    stats = df.dropna(subset=[key]).groupBy(key).agg(
        F.avg(v).alias("_mean"), F.max(v).alias("_max"),
        share_percent(v > K.GUIDELINE_ANNUAL).alias("_above"), share_percent(v > K.GUIDELINE_HIGH).alias("_high"),
        F.count(F.lit(1)).alias("data_points"))
    mean = F.col("_mean")
    category = estimator_category(mean)
    out = stats.select(
        key, round_stable(mean, 2).alias("mean_pm25"), round_stable(F.col("_max"), 2).alias("max_pm25"),
        category["category"].alias("air_quality_category"), category["color"].alias("category_color"),
        round_stable(F.col("_above"), 1).alias("percent_above_guideline"),
        round_stable(F.col("_high"), 1).alias("percent_hazardous"),
        excess_risk_entries(mean).alias("excess_health_risks"), "data_points")
    if sensors is None:
        return out
    places = keep_first(sensors.select(key, *location), [key], location)
    return out.join(places, key, "left")


def health_rollup(summary: DataFrame, population: int = 1_000_000) -> DataFrame:
    """A20 + P13: unweighted mean of the rounded sensor means and its yearly impact, in one row."""
    overall = summary.agg(F.avg("mean_pm25").alias("avg_pm25"), F.count(F.lit(1)).alias("sensors"))
    return overall.select("avg_pm25", "sensors", *population_impact_columns(F.col("avg_pm25"), population))
