"""Histogram and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazeline.operators.joins import attach
from hazeline.operators.quantiles import exact_quantiles, one_row, present_values
from hazeline.session import materialized


def histogram(df: DataFrame, value: str = "pm25", bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, empty bins included, last bin closed.

    A constant column gets the range widened by one half on both sides. The range comes from a
    scalar aggregate; a row may be moved one bin when the quotient disagrees with the bin edges.
    """
    v = F.col(value)
    known = df.where(v.isNotNull())
    limits = known.agg(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                           F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = known.select(v.cast("double").alias("v"), one_row(limits).alias("r"))
    width = (F.col("r.hi") - F.col("r.lo")) / bins
    first = F.least(F.floor((F.col("v") - F.col("r.lo")) / (F.col("r.hi") - F.col("r.lo")) * bins), F.lit(bins - 1))
    placed = placed.withColumn("w", width).withColumn("i", first)
    low_edge = F.col("r.lo") + F.col("i") * F.col("w")
    high_edge = F.col("r.lo") + (F.col("i") + 1) * F.col("w")
    bin_no = (F.when(F.col("v") < low_edge, F.col("i") - 1)
               .when((F.col("v") >= high_edge) & (F.col("i") < bins - 1), F.col("i") + 1)
               .otherwise(F.col("i")))
    counts = placed.groupBy(bin_no.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    out = spine.join(counts, "bin", "left").withColumn("r", one_row(limits)).where(F.col("r.lo").isNotNull())
    step = (F.col("r.hi") - F.col("r.lo")) / bins
    return out.select("bin", (F.col("r.lo") + F.col("bin") * step).alias("bin_start"),
                      F.when(F.col("bin") == bins - 1, F.col("r.hi"))
                       .otherwise(F.col("r.lo") + (F.col("bin") + 1) * step).alias("bin_end"),
                      F.coalesce("frequency", F.lit(0)).alias("frequency"))


def _with_fences(df: DataFrame, keys: Sequence[str], value: str, reach: float) -> DataFrame:
    """Present values of every group with its quartiles and fences, one row per group that is attached by its size."""
    rows = present_values(df, value, keys)
    quart = materialized(exact_quantiles(rows, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys), "quartiles")
    spread = F.col("q3") - F.col("q1")
    fences = quart.withColumn("lo_fence", F.col("q1") - reach * spread).withColumn("hi_fence", F.col("q3") + reach * spread)
    return attach(rows, fences, keys, "inner")


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str = "pm25", reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group, summed up in the tasks that read the rows."""
    fenced = _with_fences(df, keys, value, reach)
    v = F.col("value")
    stats = fenced.groupBy(*keys, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.when(v >= F.col("lo_fence"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("hi_fence"), v)).alias("whisker_high"),
        F.count_if((v < F.col("lo_fence")) | (v > F.col("hi_fence"))).alias("outliers"))
    return (stats.withColumn("whisker_low", F.least("whisker_low", "q1"))
                 .withColumn("whisker_high", F.greatest("whisker_high", "q3")))


def boxplot_outliers(df: DataFrame, keys: Sequence[str], value: str = "pm25", reach: float = 1.5) -> DataFrame:
    """The outlying values themselves with their multiplicity."""
    v = F.col("value")
    beyond = _with_fences(df, keys, value, reach).where((v < F.col("lo_fence")) | (v > F.col("hi_fence")))
    return beyond.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
