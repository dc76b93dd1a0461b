"""A bit table of keys: a filter of fixed size before a join, whatever the number of keys.

Keys that are in the table always pass; others pass as often as the table is full, and are dropped by the join. So the
table only saves work, and results never hang on its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TABLE_BITS = 1 << 22


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """One row: TABLE_BITS bits as longs, with a bit set for each key."""
    bit = F.col(key).bitwiseAND(TABLE_BITS - 1)
    set_ = (keys.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")))
    places = keys.sparkSession.range(TABLE_BITS // 64).withColumnRenamed("id", "at")
    filled = places.join(set_, "at", "left").select("at", F.coalesce("bits", F.lit(0)).alias("bits"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).getField("bits").alias("bits"))


def in_table(key: Column, table: Column) -> Column:
    place = F.shiftright(key.bitwiseAND(TABLE_BITS - 1), 6).cast("int")
    return F.coalesce(F.getbit(F.get(table, place), key.bitwiseAND(63).cast("int")) == 1, F.lit(False))
