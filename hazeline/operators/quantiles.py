"""Exact quantiles by repeated refinement.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here only counts of value ranges
leave a task: rows are counted by coarse ranges, the ranges that hold a wanted rank are kept with their least and
greatest value, and a range with more than SMALL rows is cut into CELLS parts between those two and counted again. A
range of a single value needs no more; the values of a small range are put in order. So no window ever sees more than
the ranges of one group or SMALL rows, whatever the skew, and rows that hold no wanted rank are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazeline.session import materialized

RANGES_PER_OCTAVE = 256
CELLS = 4096
SMALL = 1 << 16


def present_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys and ``value`` as double; missing values, NaN included, and missing keys drop out, as in a pandas group-by."""
    v = F.col(value).cast("double")
    return df.select(*keys, v.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value")).dropna(subset=list(keys) or None)


def _range(v: Column) -> Column:
    """Number of a coarse range, never less for a greater ``v``: equal steps of log2(1 + |v|), mirrored below zero."""
    steps = F.floor(F.log2(F.lit(1.0) + F.abs(v)) * F.lit(float(RANGES_PER_OCTAVE)))
    return F.when(v < 0, -steps).otherwise(steps)


def _ranks(probs: Sequence[float], total: Column) -> Column:
    """Distinct zero-based ranks next to each quantile position."""
    spots = [F.lit(float(p)) * (total - 1) for p in probs]
    return F.array_distinct(F.array(*[f(s).cast("long") for s in spots for f in (F.floor, F.ceil)]))


def _holding(counts: DataFrame, within: Sequence[str], order: str, probs: Sequence[float]) -> DataFrame:
    """Entries that contain a wanted rank; ``base`` becomes the number of values ahead of the entry."""
    ahead = F.coalesce(F.sum("n").over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.filter(_ranks(probs, F.col("total")), lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n")))
    placed = counts.withColumn("base", F.col("base") + ahead).withColumn("ranks", inside)
    return placed.where(F.size("ranks") > 0)


def _hits(picked: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return picked.select(*group, "total", F.col(value).alias("value"), F.explode("ranks").alias("rank"))


def _ranked(rows: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group, total, value, rank) for every wanted rank of ``rows`` (group, value)."""
    totals = W.partitionBy(*group)
    bounds = [F.min("value").alias("lo"), F.max("value").alias("hi")]
    located, key = rows.withColumn("c0", _range(F.col("value"))), [*group, "c0"]
    counts = located.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *bounds)
    counts = counts.withColumn("total", F.sum("n").over(totals)).withColumn("base", F.lit(0).cast("long"))
    found: DataFrame | None = None

    def add(hits: DataFrame) -> None:
        nonlocal found
        found = hits if found is None else found.unionByName(hits)

    within = list(group)
    while True:
        # a few rows per group, written: the next pass over the rows knows the size of this side of its join
        picked = materialized(_holding(counts, within, key[-1], probs), "ranges")
        add(_hits(picked.where("lo = hi"), group, "lo"))
        many = picked.where("lo < hi")
        left = many.agg(F.count_if(F.col("n") <= SMALL).alias("small"), F.count_if(F.col("n") > SMALL).alias("large")).first()
        if left["small"]:
            inside = located.join(many.where(F.col("n") <= SMALL).select(*key, "base", "total"), key)
            values = inside.groupBy(*key, "base", "total", "value").agg(F.count(F.lit(1)).alias("n"))
            add(_hits(_holding(values, key, "value", probs), group, "value"))
        if not left["large"]:
            return found
        cell = f"c{len(key) - len(group)}"
        share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        located = (located.join(many.where(F.col("n") > SMALL).select(*key, "lo", "hi", "base", "total"), key)
                   .withColumn(cell, F.least(F.floor(share * CELLS), F.lit(CELLS - 1))))
        counts = located.groupBy(*key, cell, "base", "total").agg(F.count(F.lit(1)).alias("n"), *bounds)
        located, within, key = located.drop("lo", "hi", "base", "total"), key, [*key, cell]


def exact_quantiles(rows: DataFrame, probs: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``rows`` (keys, value) with a linearly interpolated quantile per entry of ``probs``
    (name -> probability). The rows are read two times or more, all but the last when the plan is built."""
    group = list(keys) or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    hits = _ranked(rows, group, list(dict.fromkeys(probs.values())))

    def interpolated(p: float) -> Column:
        spot = F.lit(float(p)) * (F.max("total") - 1)
        # the rank test sits inside the aggregate, where ``total`` is constant per group
        row_spot = F.lit(float(p)) * (F.col("total") - 1)
        low = F.max(F.when(F.col("rank") == F.floor(row_spot), F.col("value")))
        high = F.max(F.when(F.col("rank") == F.ceil(row_spot), F.col("value")))
        return F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot)))

    out = hits.groupBy(*group).agg(*[interpolated(p).alias(name) for name, p in probs.items()])
    return out if keys else out.drop("_all")


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (),
              approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Quantiles per group; ``approx`` trades exactness for a single mergeable sketch pass."""
    if not approx:
        return exact_quantiles(present_values(df, value, keys), probs, keys)
    src = df.dropna(subset=list(keys)) if keys else df
    sketch = F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs.values()], accuracy)
    out = src.groupBy(*keys).agg(sketch.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct column, usable in any expression (scalar subquery)."""
    return df.select(F.struct("*").alias("s")).scalar()
