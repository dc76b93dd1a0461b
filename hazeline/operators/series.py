"""Order-dependent operators: gap filling, resampling, rolling means.

A window over one sensor would put that sensor's whole history into one task. Here a window only
ever spans one (sensor, time bucket), and buckets that hold too many rows are cut into slices by rank: a histogram of
the bucket's times says where, and what is still too large is cut again, down to a microsecond. What a bucket needs
from outside, the nearest known reading before and after it, is found on a table of one row per bucket and added to the
bucket as two boundary rows, which are removed again after the window has run. That table is scanned in blocks: within
a bucket's slices, within a block of buckets, over the blocks, and back down, so no window spans all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazeline.functions.numeric import HOUR_US, epoch_micros, floor_div, null_if_nan
from hazeline.operators.aggregate import daily_mean
from hazeline.operators.joins import attach
from hazeline.session import materialized

FILL_METHODS = ("interpolate_time", "interpolate_linear", "ffill", "bfill", "mean")
# rows without a place in a series belong to no window; a hash spreads them over buckets ahead of all others
_SPARE_BASE = -(1 << 62)
# bucket width when a row number stands in for time
_ROWS_PER_BUCKET = 1 << 20
# a dense bucket's histogram, and buckets that are scanned together
_CELLS = 1024
_BLOCK = 1024


def _spare_bucket(*cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in cols]), 16) + _SPARE_BASE


def _bucketed(df: DataFrame, ts: str, group: Sequence[str], order: Sequence[str], width_us: int,
              max_rows: int | None) -> DataFrame:
    """Add the position on the axis (``_us``) and its bucket; without a time column the first order column is it.

    Rows without time or key belong to no series.
    """
    if ts in df.columns:
        axis, width = epoch_micros(df, ts), width_us
    else:
        axis, width = F.col(order[0]).cast("long"), _ROWS_PER_BUCKET
    for k in group:
        axis = F.when(F.col(k).isNotNull(), axis)
    return _with_buckets(df.withColumn("_us", axis), group, order or [ts], width, max_rows)


def _with_buckets(placed: DataFrame, group: Sequence[str], spread_by: Sequence[str], width: int,
                  max_rows: int | None) -> DataFrame:
    """Add ``_bucket``, where the bucket of ``_us`` begins, with buckets of more than ``max_rows`` cut into slices."""
    out = placed.withColumn("_bucket", F.coalesce(floor_div(F.col("_us"), width) * width, _spare_bucket(*spread_by)))
    return out if max_rows is None else _sliced(out, group, max_rows)


def _sliced(placed: DataFrame, group: Sequence[str], max_rows: int) -> DataFrame:
    """Cut buckets with more than ``max_rows`` rows; usually one narrow count finds none, and nothing is joined.

    A round cuts a dense bucket between the cells of a histogram of its times: neighbouring cells are taken together up
    to the limit, and a cell that is too large alone becomes a slice of its own, which the next round counts and cuts
    1024 times finer. Rows of one and the same time stay together.
    """
    half = max(max_rows // 2, 1)
    key = [*group, "_bucket"]
    out = placed
    while (dense := _dense_buckets(out, group, max_rows)) is not None:
        cell = F.call_function("div", F.col("_us") - F.col("_from"), F.col("_step"))
        counts = (attach(out.where(F.col("_us").isNotNull()).select(*key, "_us"), dense, key, "inner")
                  .groupBy(*key, "_from", "_step", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n")))
        line = W.partitionBy(*key).orderBy("_cell")
        before = F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        part = F.call_function("div", before, F.lit(half).cast("long"))
        large = F.col("n") > half
        marked = counts.withColumn("_part", part).withColumn("_large", large)
        begins = (F.col("_large") | F.coalesce(F.lag("_large").over(line), F.lit(True))
                  | (F.lag("_part").over(line) != F.col("_part")))
        start = F.max(F.when(F.col("_begins"), F.col("_from") + F.col("_cell") * F.col("_step"))).over(
            line.rowsBetween(W.unboundedPreceding, W.currentRow))
        cuts = materialized(marked.withColumn("_begins", begins).select(*key, "_cell", start.alias("_start")), "cuts")
        placed_again = attach(out, dense, key).withColumn("_cell", cell)
        out = (attach(placed_again, cuts, [*key, "_cell"]).withColumn("_bucket", F.coalesce("_start", "_bucket"))
               .drop("_from", "_step", "_cell", "_start"))
    return out


def _dense_buckets(bucketed: DataFrame, group: Sequence[str], max_rows: int) -> DataFrame | None:
    """Buckets with more than ``max_rows`` rows and more than one time, their first time and cell width; or None."""
    sizes = (bucketed.where(F.col("_us").isNotNull()).groupBy(*group, "_bucket")
             .agg(F.count(F.lit(1)).alias("n"), F.min("_us").alias("_from"), F.max("_us").alias("_to")))
    width = F.ceil((F.col("_to") - F.col("_from") + 1) / _CELLS).cast("long")
    dense = (sizes.where((F.col("n") > max_rows) & (F.col("_to") > F.col("_from")))
             .select(*group, "_bucket", "_from", width.alias("_step")))
    dense = materialized(dense, "dense-buckets")
    return None if dense.isEmpty() else dense


# what is carried from one bucket to others: (new column, source column, "max", "min" or "sum", "before" or "after")
_KNOTS = (("_before", "_last", "max", "before"), ("_after", "_first", "min", "after"))
_MERGE = {"max": F.max, "min": F.min, "sum": F.sum}


def _scanned(rows: DataFrame, within: Sequence[str], at: str, scans) -> DataFrame:
    """What the rows of the same part before or after each row hold together."""
    frame = {"before": W.partitionBy(*within).orderBy(at), "after": W.partitionBy(*within).orderBy(F.desc(at))}
    return rows.withColumns({new: _MERGE[how](source).over(frame[side].rowsBetween(W.unboundedPreceding, -1))
                             for new, source, how, side in scans})


def carried_over(rows: DataFrame, group: Sequence[str], at: str, widths: Sequence[int], scans=_KNOTS) -> DataFrame:
    """A blockwise prefix scan of ``rows`` by ``at``: what all rows of the group before (after) each hold together.

    Rows are merged into blocks of the first of ``widths``, those into blocks of the next; the last blocks are scanned
    as a whole, and what comes from outside a block goes back down. Nearest knots lie in order, so an inner one wins.
    """
    if not widths:
        return _scanned(rows, group, at, scans)
    up, inner = f"{at}_", [*group, f"{at}_"]
    rows = rows.withColumn(up, floor_div(F.col(at), widths[0]) * widths[0])
    sources = {source: how for _, source, how, _ in scans}
    blocks = rows.groupBy(*inner).agg(*[_MERGE[how](source).alias(source) for source, how in sources.items()])
    outside = carried_over(blocks, group, up, widths[1:], scans).select(*inner, *[F.col(s[0]).alias(f"{s[0]}_") for s in scans])
    out = _scanned(rows, inner, at, scans).join(outside, inner)
    for new, _, how, _ in scans:
        mine, theirs = F.col(new), F.col(f"{new}_")
        both = F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0)) if how == "sum" else F.coalesce(mine, theirs)
        out = out.withColumn(new, both)
    return out.drop(up, *[f"{s[0]}_" for s in scans])


def _fill_time(rows: DataFrame, value: str, group: list[str], order: Sequence[str], widths: Sequence[int]) -> DataFrame:
    seq = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    rows = rows.withColumn("_edge", F.lit(False))
    knot = F.when(F.col(value).isNotNull() & F.col("_us").isNotNull(),
                  F.struct(F.col("_us").alias("us"), seq.alias("seq"), F.col(value).cast("double").alias("v")))
    edges = materialized(rows.where(F.col("_us").isNotNull()).groupBy(*group, "_bucket")
                         .agg(F.min(knot).alias("_first"), F.max(knot).alias("_last")), "edges")
    carried = (carried_over(edges, group, "_bucket", widths)
               .select(*group, "_bucket", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_k"))
               .select(*group, "_bucket", F.col("_k.us").alias("_us"), F.col("_k.v").alias(value),
                       F.lit(True).alias("_edge")))
    part = W.partitionBy(*group, "_bucket")
    up_to = W.unboundedPreceding, W.currentRow
    filled = (rows.unionByName(carried, allowMissingColumns=True)
              .withColumn("_prev", F.max(knot).over(part.orderBy("_us").rangeBetween(*up_to)))
              .withColumn("_next", F.min(knot).over(part.orderBy(F.desc("_us")).rangeBetween(*up_to)))
              .where(~F.col("_edge")))
    prev, nxt = F.col("_prev"), F.col("_next")
    line = prev["v"] + (nxt["v"] - prev["v"]) * ((F.col("_us") - prev["us"]) / (nxt["us"] - prev["us"]))
    result = (F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
               .when(F.col("_us").isNull() | prev.isNull(), F.lit(None).cast("double"))
               .when(nxt.isNull() | (prev["us"] == F.col("_us")), prev["v"])
               .otherwise(line))
    return filled.withColumn(value, result)


def _fill_position(rows: DataFrame, value: str, group: list[str], order: Sequence[str], method: str,
                   limit: int | None, widths: Sequence[int]) -> DataFrame:
    rows = rows.withColumn("_edge", F.lit(False))
    part = W.partitionBy(*group, "_bucket")
    asc = [F.asc("_us"), *[F.asc(c) for c in order]]
    desc = [F.desc("_us"), *[F.desc(c) for c in order]]
    up_to = W.unboundedPreceding, W.currentRow
    known = F.col(value).isNotNull() & F.col("_us").isNotNull()

    # narrow pass: where the first and last knot of each bucket sit, counted from the bucket's start
    place = F.struct(F.col("_pos").alias("pos"), F.col(value).cast("double").alias("v"))
    edges = (rows.where(F.col("_us").isNotNull()).select(*group, "_bucket", "_us", *order, value)
             .withColumn("_pos", F.row_number().over(part.orderBy(*asc)).cast("long"))
             .groupBy(*group, "_bucket")
             .agg(F.min(F.when(known, place)).alias("_f"), F.max(F.when(known, place)).alias("_l"),
                  F.count("_us").alias("_n")))
    edges = materialized(edges, "edges")

    def shifted(name: str) -> Column:
        k = F.col(name)
        return F.when(k.isNotNull(), F.struct((k["pos"] + F.col("_start")).alias("pos"), k["v"].alias("v")))

    edges = (carried_over(edges, group, "_bucket", widths, [("_start", "_n", "sum", "before")])
             .withColumn("_start", F.coalesce("_start", F.lit(0)))
             .withColumn("_first", shifted("_f")).withColumn("_last", shifted("_l")))
    edges = materialized(edges, "edges")
    # boundary rows sort before or after every row of the bucket and know their distance to it
    carried = (carried_over(edges, group, "_bucket", widths)
               .select(*group, "_bucket", "_start", F.explode(F.array(
                   F.struct(F.col("_before").alias("k"), F.lit(-(1 << 62)).alias("us")),
                   F.struct(F.col("_after").alias("k"), F.lit(1 << 62).alias("us")))).alias("_e"))
               .where(F.col("_e.k").isNotNull())
               .select(*group, "_bucket", F.col("_e.us").alias("_us"), F.col("_e.k.v").alias(value),
                       (F.col("_e.k.pos") - F.col("_start")).alias("_at"), F.lit(True).alias("_edge")))

    both = rows.withColumn("_at", F.lit(None).cast("long")).unionByName(carried, allowMissingColumns=True)
    counted = F.sum(F.when(F.col("_edge"), 0).otherwise(1)).over(part.orderBy(*asc).rowsBetween(*up_to))
    knot = F.when(known, F.struct(F.col("_pos").alias("pos"), F.col(value).cast("double").alias("v")))
    filled = (both.withColumn("_pos", F.coalesce("_at", counted))
                  .withColumn("_prev", F.last(knot, ignorenulls=True).over(part.orderBy(*asc).rowsBetween(*up_to))))
    if method != "ffill":
        filled = filled.withColumn(
            "_next", F.last(knot, ignorenulls=True).over(part.orderBy(*desc).rowsBetween(*up_to)))
    else:
        filled = filled.withColumn("_next", F.lit(None).cast("struct<pos:bigint,v:double>"))
    filled = filled.where(~F.col("_edge"))

    prev, nxt, pos = F.col("_prev"), F.col("_next"), F.col("_pos")
    near_prev = F.lit(True) if limit is None else pos - prev["pos"] <= limit
    near_next = F.lit(True) if limit is None else nxt["pos"] - pos <= limit
    if method == "interpolate_linear":
        line = prev["v"] + (nxt["v"] - prev["v"]) * ((pos - prev["pos"]) / (nxt["pos"] - prev["pos"]))
        guess = F.when(prev.isNotNull() & near_prev, F.when(nxt.isNull(), prev["v"]).otherwise(line))
    elif method == "ffill":
        guess = F.when(near_prev, prev["v"])
    else:
        guess = F.when(near_next, nxt["v"])
    result = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("_us").isNotNull(), guess)
    return filled.withColumn(value, result)


def fill_gaps(df: DataFrame, value: str = "pm25", ts: str = "date", keys: Sequence[str] = ("sensor_id",),
              order: Sequence[str] = (), method: str = "interpolate_time", limit: int | None = 7,
              bucket_hours: int = 720, max_bucket_rows: int | None = 2_000_000) -> DataFrame:
    """Fill missing readings.

    interpolate_time   linear in elapsed time; leading gaps stay, trailing ones take the last value
    interpolate_linear linear by row position, at most ``limit`` rows into a gap
    ffill / bfill      previous / next reading, at most ``limit`` rows away
    mean               overall mean

    ``order`` breaks ties between equal times and should make rows unique. With ``keys=()`` the whole
    table is one series, as in the original tool; it is still processed bucket by bucket. Rows without
    a time or a key are left as they are. ``df`` is read three times (count, boundaries, rows), the first two when the
    plan is built, and one row per bucket is written: pass a table or a cheap plan, and ``materialized`` anything else. Without a ``ts`` column every method becomes linear along the
    first ``order`` column, a row number.
    """
    if method not in FILL_METHODS:
        raise ValueError(f"unknown fill method: {method}; expected one of {FILL_METHODS}")
    columns = df.columns
    if method == "mean" and ts in columns:
        return df.withColumn(value, F.coalesce(F.col(value), df.agg(F.avg(value)).scalar()))
    if ts not in columns:
        if not order:
            raise ValueError(f"no column {ts}: name a row number in order")
        method = "interpolate_linear"
    group = list(keys)
    work = df
    if not group:
        group, work = ["_all"], df.withColumn("_all", F.lit(0))
    rows = _bucketed(work, ts, group, order, bucket_hours * HOUR_US, max_bucket_rows)
    width = bucket_hours * HOUR_US if ts in columns else _ROWS_PER_BUCKET
    widths = [width, width * _BLOCK]  # a bucket's slices, then blocks of buckets
    if method == "interpolate_time":
        out = _fill_time(rows, value, group, order, widths)
    else:
        out = _fill_position(rows, value, group, order, method, limit, widths)
    return out.select(*columns)


def resample_daily(df: DataFrame, keys: Sequence[str] = ("sensor_id",), value: str = "pm25",
                   day: str = "date") -> DataFrame:
    """One row per calendar day from a key's first to its last day; days without data are NULL."""
    means = daily_mean(df, keys, value, day)
    span = means.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return days.join(means, [*keys, day], "left")


def rolling_means(df: DataFrame, hours: Sequence[int] = (3, 6), value: str = "pm25", ts: str = "datetime",
                  keys: Sequence[str] = ("sensor_id",), bucket_hours: int = 24, slot_minutes: int = 5) -> DataFrame:
    """Mean of the readings in the ``h`` hours before each row, the row itself excluded.

    A window is the rest of the slot in which it begins, the whole slots after it, and the start of the row's own slot.
    Each part is a sum that only grows, over the readings of one slot or over a table of one row per slot, so no reading
    outside the window ever touches its mean, and a row costs the same in a dense series as in a sparse one. Slots of
    ``slot_minutes`` (a divisor of 60) and buckets of slots bound what one task sorts. A missing reading, NaN included,
    counts for nothing; rows without time or key get no mean.
    """
    if slot_minutes < 1 or 60 % slot_minutes:
        raise ValueError("slot_minutes must divide an hour")
    columns, slot_us = df.columns, slot_minutes * 60_000_000
    per_hour = 60 // slot_minutes
    rows = _bucketed(df, ts, keys, columns, slot_us, None)
    rows = rows.withColumn("_bucket", F.coalesce(floor_div(F.col("_us"), slot_us), "_bucket"))  # slots are counted
    v = null_if_nan(F.col(value).cast("double"))
    rows = rows.withColumn("_v", F.when(F.col("_us").isNotNull(), v))

    # whole slots before each slot, from one row per slot; slots near a bucket's end are repeated in the next ones
    slots = (rows.where("_us is not null").groupBy(*keys, "_bucket")
             .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"), F.count("_v").alias("_n")))
    width, reach = bucket_hours * per_hour, max(hours) * per_hour
    own = floor_div(F.col("_bucket"), width)
    spread = slots.withColumn("_own", own).withColumn(
        "_span", F.explode(F.sequence("_own", floor_div(F.col("_bucket") + F.lit(reach), width))))
    near = W.partitionBy(*keys, "_span").orderBy("_bucket")
    for h in hours:
        frame = near.rangeBetween(1 - h * per_hour, -1)
        spread = spread.withColumn(f"_s{h}", F.coalesce(F.sum("_s").over(frame), F.lit(0.0))).withColumn(
            f"_n{h}", F.coalesce(F.sum("_n").over(frame), F.lit(0)))
    whole = (spread.where(F.col("_own") == F.col("_span"))
             .select(*keys, "_bucket", *[f"_{c}{h}" for h in hours for c in "sn"]))

    # a copy of each reading, h hours later, meets the rows whose window begins in its slot
    late = F.filter(F.array(*[F.lit(h) for h in (0, *hours)]), lambda h: (h == 0) | F.col("_v").isNotNull())
    placed = (rows.withColumn("_late", F.explode(late))
              .withColumn("_bucket", F.col("_bucket") + F.col("_late") * per_hour)
              .withColumn("_us", F.col("_us") + F.col("_late").cast("long") * F.lit(HOUR_US)))
    slot = W.partitionBy(*keys, "_bucket").orderBy("_us")

    def part(late_by: int, frame) -> tuple[Column, Column]:
        mine = F.when(F.col("_late") == late_by, F.col("_v"))
        return F.coalesce(F.sum(mine).over(frame), F.lit(0.0)), F.count(mine).over(frame)

    head, n_head = part(0, slot.rangeBetween(W.unboundedPreceding, -1))
    out = placed.withColumn("_head", head).withColumn("_n_head", n_head)
    backwards = W.partitionBy(*keys, "_bucket").orderBy(F.desc("_us")).rangeBetween(W.unboundedPreceding, W.currentRow)
    for h in hours:
        tail, n_tail = part(h, backwards)
        out = out.withColumn(f"_tail{h}", tail).withColumn(f"_n_tail{h}", n_tail)
    out = out.where(F.col("_late") == 0).join(whole, [*keys, "_bucket"], "left")
    for h in hours:
        n = F.col("_n_head") + F.col(f"_n_tail{h}") + F.coalesce(f"_n{h}", F.lit(0))
        total = F.col("_head") + F.col(f"_tail{h}") + F.coalesce(f"_s{h}", F.lit(0.0))
        out = out.withColumn(f"{value}_mean_{h}h", F.when((n > 0) & F.col("_us").isNotNull(), total / n))
    return out.select(*columns, *[f"{value}_mean_{h}h" for h in hours])
