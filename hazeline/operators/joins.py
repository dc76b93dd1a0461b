"""Joins with sensor metadata (J1-J4) and set union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
# a key with more facts than this is cut; candidates that the frequent-items sketch keeps
HEAVY_ROWS = 1_000_000
TRACKED = 4096


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure a small side before broadcasting it: each task sends one count and one size, no rows.

    Fixed-width columns count by their type, so only the lengths of texts and nested values are computed.
    """
    fixed, sizes = 0, []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(col))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            sizes.append(F.octet_length(F.to_json(F.struct(col))))
        else:
            fixed += 8
    width = F.lit(fixed)
    for size in sizes:
        width = width + F.coalesce(size, F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    return row["rows"] <= max_rows and row["bytes"] <= max_bytes


def _key_hash(on: Sequence[str], common: T.StructType) -> Column:
    """A hash of the key that is the same on both sides of a join, whatever their number types."""
    def alike(name: str) -> Column:
        col = F.col(f"`{name}`").cast(common[name].dataType)
        return F.when(col == 0, F.lit(0.0)).otherwise(col) if isinstance(common[name].dataType, T.FractionalType) else col
    return F.xxhash64(*[alike(c) for c in on])


def heavy_keys(facts: DataFrame, on: Sequence[str], hashed: Column, heavy_rows: int, tracked: int = TRACKED) -> DataFrame:
    """Keys with more than about ``heavy_rows`` rows and the number of parts that they are to be cut into.

    One pass with a frequent-items sketch over key hashes, which never counts a key too low: a key that is not heavy may
    be cut without need, a heavy one is not missed while there are fewer than ``tracked`` keys of that size. At most
    ``tracked`` rows come to the driver, two numbers each.
    """
    found = facts.dropna(subset=list(on)).select(hashed.alias("h")).agg(
        F.expr(f"approx_top_k(h, {tracked // 4}, {tracked})").alias("top")).first()["top"] or []
    rows = [(r["item"], -(-r["count"] // heavy_rows)) for r in found if r["count"] > heavy_rows]
    return facts.sparkSession.createDataFrame(rows, "_hash long, _parts long")


def attach(facts: DataFrame, dim: DataFrame, on: str | Sequence[str] = "sensor_id", how: str = "left",
           max_rows: int = MAX_BROADCAST_ROWS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Join facts to a dimension without ever shuffling the facts by a hot key alone.

    A dimension measured to be small is broadcast. For a larger one the keys with more than ``heavy_rows`` facts are
    found by a sketch: their facts are dealt to as many parts as their count asks for, by a hash of the plain columns,
    and their dimension rows are repeated once for each part. All other keys stay whole and nothing of them is copied.
    Sides that such a join cannot preserve (right, outer) are completed with the unmatched dimension rows.
    Duplicate dimension keys multiply rows, as in any equi-join. Other columns that both sides have
    get the endings ``_x`` (facts) and ``_y`` (dimension).
    """
    how = {"full": "outer", "full_outer": "outer", "fullouter": "outer",
           "left_outer": "left", "leftouter": "left", "right_outer": "right", "rightouter": "right"}.get(how, how)
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unsupported join type: {how}")
    on = [on] if isinstance(on, str) else list(on)
    if not set(on) <= set(facts.columns):
        return facts
    shared = [c for c in facts.columns if c in dim.columns and c not in on]
    facts = facts.withColumnsRenamed({c: f"{c}_x" for c in shared})
    dim = dim.withColumnsRenamed({c: f"{c}_y" for c in shared})
    kept = "inner" if how in ("inner", "right") else "left"
    if fits_broadcast(dim, max_rows):
        joined = facts.join(F.broadcast(dim), on, kept)
    else:
        joined = _joined_in_parts(facts, dim, on, kept, heavy_rows)
    if how in ("inner", "left"):
        return joined
    # map-side combined distinct keys: one row per key and task is shuffled, whatever the skew
    unmatched = dim.join(facts.select(*on).distinct(), on, "left_anti")
    return joined.unionByName(unmatched, allowMissingColumns=True)


def _joined_in_parts(facts: DataFrame, dim: DataFrame, on: list[str], kept: str, heavy_rows: int) -> DataFrame:
    """An equi-join whose heavy keys are cut; rows without key, which match nothing, are dealt out as well."""
    common = facts.select(*on).limit(0).unionAll(dim.select(*on).limit(0)).schema
    hashed = _key_hash(on, common)
    heavy = F.broadcast(heavy_keys(facts, on, hashed, heavy_rows))  # at most TRACKED rows of two numbers
    plain = [f.name for f in facts.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    keyless = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in on])
    left = (facts.withColumn("_hash", hashed).join(heavy, "_hash", "left")
            .withColumn("_part", F.when(keyless, spread).otherwise(F.pmod(spread, parts))).drop("_hash", "_parts"))
    right = (dim.withColumn("_hash", hashed).join(heavy, "_hash", "left")
             .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hash", "_parts"))
    return left.join(right, [*on, "_part"], kept).drop("_part")


def lookup(df: DataFrame, dim: DataFrame, on: str, column: str, default: str) -> DataFrame:
    """Dimension value with a default for unknown keys."""
    joined = attach(df, dim.select(on, column), on, "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union all by column name, absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def live_or_archive(requested: DataFrame, live: DataFrame, archive_mean: DataFrame,
                    key: str = "sensor_id", value: str = "pm25", carry: Sequence[str] = ()) -> DataFrame:
    """Live value if there is one, else the archive mean; ``source`` says which; neither drops the row.

    ``live`` and ``archive_mean`` hold one row per sensor, so both joins move per-sensor rows only. Columns in
    ``carry``, such as the time, come from the same side as the value.
    """
    # a live row wins even when its value is missing: only an absent row falls back
    now = live.select(key, F.col(value).alias("_live"), F.lit(True).alias("_is_live"),
                      *[F.col(c).alias(f"_live_{c}") for c in carry])
    past = archive_mean.select(key, F.col(value).alias("_past"), *[F.col(c).alias(f"_past_{c}") for c in carry])
    joined = requested.join(now, key, "left").join(past, key, "left")
    is_live = F.coalesce(F.col("_is_live"), F.lit(False))
    return (joined.where(is_live | F.col("_past").isNotNull())
                  .withColumn(value, F.when(is_live, F.col("_live")).otherwise(F.col("_past")))
                  .withColumn("source", F.when(is_live, "LIVE").otherwise("FILE"))
                  .withColumns({c: F.when(is_live, F.col(f"_live_{c}")).otherwise(F.col(f"_past_{c}")) for c in carry})
                  .drop("_live", "_past", "_is_live", *[f"_{side}_{c}" for side in ("live", "past") for c in carry]))
