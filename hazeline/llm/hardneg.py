"""Hard-negative mining by Fagin's threshold algorithm (operator 11).

Vectors are quantised to integers and dealt to cells of bounded size; each cell meets every batch of anchors. In a cell
the rows stand in one list per dimension, sorted by component. An anchor reads a list from its high end where its own
component is positive, from the low end where it is negative, and not at all where it is zero; rows that it meets get
their whole score at once. The sum of its components times those at the reading depth bounds the score of every row not
met, so reading stops once that threshold falls strictly below the kth score of what is sought, or below its least
score. Depth doubles from step to step.

First the positives: an anchor's best rows of its label, from lists of that label. They set windows of scores; then the
negatives: the best rows of other labels in each window. Ranks are settled over all cells.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of
rows that share a vec_id the least by (label, vector) takes part. A shorter vector counts as zero in the dimensions it
lacks. Scores are exact; they are computed on doubles where these are exact, else on Python's integers, and a score
beyond a long counts as the nearest long. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazeline.session import materialized

CELL_VALUES = 1 << 20  # components of a cell's rows: 8 MB of doubles
BATCH = 1024  # anchors that meet a cell together
FIRST_DEPTH = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, q (floor of scale times each component, as double) of the rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & whole)
    q = F.transform(x, lambda v: _floor(v * scale))
    least = F.min(F.struct(F.col("label").cast("long").alias("label"), q.alias("q"))).alias("row")
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(least).select("vec_id", "row.label", "row.q")


def _floor(v):
    """Floor that stays a double: beyond 2^53 every double is whole."""
    return F.when(F.abs(v) < 9e15, F.floor(v).cast("double")).otherwise(v)


class Cell:
    """Rows with one list of rows per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.lists = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.lists, axis=0)

    def best(self, anchor: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """Rows met and their scores, read until ``done(threshold, rows met, scores)`` or all are met."""
        n = len(self.ids)
        used = np.flatnonzero(anchor != 0)
        up, down = used[anchor[used] > 0], used[anchor[used] < 0]
        met, order, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        depth, deeper = 0, min(FIRST_DEPTH, n)
        while len(order) < n:
            if len(used):
                new = np.zeros(n, bool)
                new[self.lists[n - deeper: n - depth][:, up].ravel()] = True
                new[self.lists[depth:deeper][:, down].ravel()] = True
                fresh = np.flatnonzero(new & ~met)
            else:  # nothing to read: every score is zero
                fresh = np.arange(n)
            met[fresh] = True
            order = np.concatenate([order, fresh])
            scores = np.concatenate([scores, _in_range(self.rows[fresh] @ anchor)])
            if len(order) == n or deeper == n:
                break
            threshold = self.values[n - deeper, up] @ anchor[up] + self.values[deeper - 1, down] @ anchor[down]
            if done(threshold, order, scores):
                break
            depth, deeper = deeper, min(2 * deeper, n)
        return order, scores


def _in_range(scores: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(scores, LEAST), MOST) if scores.dtype == object else scores


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    if scores.dtype == object:
        return np.array(sorted(some.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _kth(scores: np.ndarray, k: int):
    """The kth highest score, None while there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def positives_in(cell: Cell, own: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's best k other rows of the cell: places and scores."""
    def done(threshold, order, scores) -> bool:
        kth = _kth(scores[cell.ids[order] != own], k)
        return kth is not None and threshold < kth

    order, scores = cell.best(anchor, done)
    other = cell.ids[order] != own
    order, scores = order[other], scores[other]
    first = _first(cell.ids[order], scores, k)
    return order[first], scores[first]


def negatives_in(cell: Cell, labels: np.ndarray, label: int, anchor: np.ndarray, windows: list, k: int,
                 percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (its highest score): the best k rows of another label in it, places and scores."""
    def within(scores, most):
        return (scores * 100 >= percent * most) & (scores <= most)

    def done(threshold, order, scores) -> bool:
        foreign = scores[labels[order] != label]
        for most in windows:
            if threshold * 100 < percent * most or most < 0:  # a negative score has an empty window
                continue
            kth = _kth(foreign[within(foreign, most)], k)
            if kth is None or threshold >= kth:
                return False
        return True

    order, scores = cell.best(anchor, done)
    foreign = labels[order] != label
    order, scores = order[foreign], scores[foreign]
    out = []
    for most in windows:
        inside = np.flatnonzero(within(scores, most))
        first = inside[_first(cell.ids[order[inside]], scores[inside], k)]
        out.append((order[first], scores[first]))
    return out


def _matrix(column: pa.ChunkedArray, dims: int, exact: bool) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
        lists.flatten().to_numpy(zero_copy_only=False)
    if exact:
        return out
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


def _long(scores: np.ndarray) -> pa.Array:
    return pa.array([int(s) for s in scores], pa.int64())


def _find_positives(dims: int, exact: bool, k: int):
    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and anchors.num_rows:
            data, ids, labels = _matrix(rows["q"], dims, exact), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            asked, names, wanted = _matrix(anchors["q"], dims, exact), anchors["vec_id"].to_pylist(), anchors["label"].to_numpy()
            for label in np.unique(wanted).tolist():
                mine = np.flatnonzero(labels == label)
                cell = Cell(ids[mine], data[mine])
                for i in np.flatnonzero(wanted == label).tolist() if len(mine) else ():
                    place, scores = positives_in(cell, names[i], asked[i], k)
                    out[0].extend([names[i]] * len(place))
                    out[1].extend(cell.ids[place].tolist())
                    out[2].extend(_long(scores).to_pylist())
        return pa.table([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score"])
    return find


def _find_negatives(dims: int, exact: bool, k: int, percent: int):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if rows.num_rows and anchors.num_rows:
            labels = rows["label"].to_numpy()
            cell = Cell(rows["vec_id"].to_numpy(), _matrix(rows["q"], dims, exact))
            asked = _matrix(anchors["q"], dims, exact)
            for i, (own, label, windows) in enumerate(zip(*(anchors[c].to_pylist() for c in ("vec_id", "label", "windows")))):
                found = negatives_in(cell, labels, label, asked[i], [w["positive_score"] for w in windows], k, percent)
                for window, (place, scores) in zip(windows, found):
                    for values, more in zip(out, ([own] * len(place), [window["positive_id"]] * len(place),
                                                  [window["positive_score"]] * len(place), cell.ids[place].tolist(),
                                                  _long(scores).to_pylist())):
                        values.extend(more)
        return pa.table([pa.array(c, pa.int64()) for c in out], names)
    return find


def _dealt(rows: DataFrame, anchors: DataFrame, cells: int, batches: int):
    """Rows by (cell, batch) and anchors by (batch, cell): every pair of cell and batch meets once."""
    left = (rows.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(cells)))
            .withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))))
    named = [F.col(c).alias(c) for c in anchors.columns]  # both sides come from one table
    right = (anchors.select(*named).withColumn("batch", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(batches)).cast("int"))
             .withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))))
    return left.groupBy("cell", "batch"), right.groupBy("cell", "batch")


def _ranked(found: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    place = W.partitionBy(*group).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are (vec_id, label, q) with distinct vec_id; ``is_anchor`` says which of them ask. Each anchor's first
    ``positives`` rows of its label open windows from percent/100 of their score up to it; each window gets the first
    ``negatives`` rows of other labels. Two tables are written: the rows, so that counts and both passes read them, and
    the positives.
    """
    spark = rows.sparkSession
    rows = materialized(rows, "vectors")
    anchors = rows.where(is_anchor)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("q")).alias("dims"),
                    F.max(F.array_max(F.transform("q", F.abs))).alias("largest")).first()
    n, dims, largest = size["n"], max(size["dims"] or 0, 1), size["largest"] or 0.0
    exact = dims * largest * largest * 100 < 2 ** 53
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(1, -(-size["anchors"] // BATCH))
    cells = max(-(-n * dims // CELL_VALUES), -(-parts // batches))
    left, right = _dealt(rows, anchors, cells, batches)
    found = left.cogroup(right).applyInArrow(_find_positives(dims, exact, positives),
                                             "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = materialized(_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))  # at most ``positives`` each
    left, right = _dealt(rows, anchors.join(windows, "vec_id"), cells, batches)
    found = left.cogroup(right).applyInArrow(
        _find_negatives(dims, exact, negatives, percent),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    out = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Hard negatives of the embeddings table: labels of ids divisible by 7 are moved on by one of ten first, and every
    ``every``th id is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(vectors.withColumn("label", label))
    return hard_negatives(rows, F.col("vec_id") % every == 0)
