"""Tree models for every key at once (M3, M5): one model per sensor without a loop over sensors.

Trees grow level by level over histograms. A level is one aggregation of all rows by (key, tree, node, feature, bin);
splits come from a window over the at most ``max_bins`` bins of a (key, tree, node, feature); a model is one row per key
and meets the rows in a join. So the number of jobs depends on the depth, for boosted trees also on their number, and
never on the number of keys, and a key with a third of the rows is summed up in all tasks.

Targets are summed as whole numbers of 1/SCALE, so sums and splits do not depend on the order of rows. Ties go to the
first feature, then to the lowest bin. A missing feature lies below all bins; rows without key or label are not used for
training, and keys without training rows have no model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hazeline.session import materialized

SCALE = 1_000_000
KINDS = ("tree", "random_forest", "gbt")
_SPLIT = "struct<f:int,b:int>"


@dataclass(frozen=True)
class KeyedTrees:
    """A model per key: ``table`` has the bin edges, the base value and the trees of each key, ``gains`` the splits."""

    keys: tuple[str, ...]
    features: tuple[str, ...]
    depth: int
    rate: float
    table: DataFrame
    gains: DataFrame

    def predict(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Rows of keys that have a model, with their prediction."""
        columns = [F.col(f"`{c}`") for c in df.columns]
        rows = df.join(self.table, list(self.keys)).withColumn("_x", _bins(self.features))
        return rows.select(*columns, (F.col("_base") + F.lit(self.rate) * _total(self.depth)).alias(prediction))

    def importance(self) -> DataFrame:
        """M5: share of the squared error that each feature took away, per key; keys with any split have every feature."""
        found = self.gains.groupBy(*self.keys, "f").agg(F.sum("gain").alias("gain"))
        names = F.array(*[F.lit(n) for n in self.features])
        whole = found.groupBy(*self.keys).agg(F.sum("gain").alias("_all"), *[
            F.coalesce(F.sum(F.when(F.col("f") == i, F.col("gain"))), F.lit(0.0)).alias(f"_g{i}") for i in range(len(self.features))])
        shares = F.array(*[F.col(f"_g{i}") / F.col("_all") for i in range(len(self.features))])
        return whole.select(*self.keys, F.explode(F.arrays_zip(names.alias("feature"), shares.alias("importance"))).alias("_e")) \
            .select(*self.keys, F.col("_e.feature"), F.col("_e.importance"))


def _bins(features: Sequence[str]) -> Column:
    """The bin of every feature: how many edges lie below its value."""
    def one(i: int, name: str) -> Column:
        x = F.col(f"`{name}`").cast("double")
        return F.when(x.isNull() | F.isnan(x), -1).otherwise(
            F.size(F.filter(F.get("_edges", F.lit(i)), lambda e: e < x))).cast("int")
    return F.array(*[one(i, n) for i, n in enumerate(features)])


def _edges(df: DataFrame, keys: Sequence[str], features: Sequence[str], max_bins: int,
           levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """Bin edges of each key: given levels, else its quantiles from a mergeable sketch."""
    probs = [i / max_bins for i in range(1, max_bins)]
    sketches = [F.percentile_approx(F.col(f"`{n}`").cast("double"), probs, 10_000).alias(f"_q{i}")
                for i, n in enumerate(features) if n not in levels]
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sketches)
    edges = [F.array(*[F.lit(float(v)) for v in levels[n]]) if n in levels
             else F.coalesce(F.array_distinct(f"_q{i}"), F.array().cast("array<double>")) for i, n in enumerate(features)]
    return found.select(*keys, F.array(*edges).alias("_edges"))


def _leaf(splits: Column, depth: int) -> Column:
    """The node of a row in one tree: from the root down, left where its bin is not above the split's."""
    def down(node: Column, _) -> Column:
        return _step(node, F.get(splits, node))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) if depth else F.lit(0)


def _step(node: Column, split: Column) -> Column:
    """The child that a row goes to; without a split it stays."""
    right = (F.get("_x", split["f"]) > split["b"]).cast("int")
    return F.when(split.isNull(), node).otherwise(2 * node + 1 + right)


def _total(depth: int) -> Column:
    """Sum of the leaves that a row reaches, over the trees of its key."""
    return F.aggregate("_trees", F.lit(0.0), lambda total, tree: total + F.coalesce(
        F.get(tree["leaves"], _leaf(tree["splits"], depth)), F.lit(0.0)))


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """The rows in each tree's sample, ``_w`` times: Poisson with mean 1, from a hash of the row, so repeatable."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("_tree"), F.col("_row")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    bounds = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(12)]
    times = reduce(lambda a, b: a + b, [(F.col("_u") >= F.lit(b)).cast("long") for b in bounds])
    return rows.withColumn("_u", u).where(F.col("_u") >= bounds[0]).withColumn("_w", times).drop("_u")


def _tried(spark: SparkSession, n_trees: int, level: int, seed: int, share: tuple[int, int]) -> DataFrame:
    """The features that each node of a level tries, its own few, as ``_f``: one row for each tree and node."""
    width = 2**level
    node = (width - 1 + F.col("id") % width).cast("int")
    order = F.transform(F.sequence(F.lit(0), F.lit(share[1] - 1)), lambda i: F.struct(
        F.xxhash64(F.lit(seed), F.col("_tree"), F.col("_node"), i).alias("h"), i.alias("f")))
    return spark.range(n_trees * width).select(F.floor(F.col("id") / width).cast("int").alias("_tree"), node.alias("_node")).select(
        "_tree", "_node", F.transform(F.slice(F.array_sort(order), 1, share[0]), lambda e: e["f"]).alias("_f"))


def _best_splits(placed: DataFrame, keys: Sequence[str], n_nodes: int, tried: DataFrame, min_rows: int) -> DataFrame:
    """The best split of every (key, tree, node) in ``tried``: f, b and gain, where any split gains.

    Rows in other nodes, which have become leaves, find no partner there. Only cells of features that a node tries are
    made. Tree and node travel as one number, ``_at``.
    """
    weighed = (F.col("_w") * F.col("_r")).alias("_s")
    at = (F.col("_tree") * n_nodes + F.col("_node")).alias("_at")
    cells = placed.join(F.broadcast(tried), ["_tree", "_node"]).select(*keys, at, "_w", weighed, "_x", F.explode("_f").alias("f")) \
        .select(*keys, "_at", "_w", "_s", "f", F.get("_x", F.col("f")).alias("b"))
    sums = cells.groupBy(*keys, "_at", "f", "b").agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    feature = W.partitionBy(*keys, "_at", "f").orderBy("b")
    up_to = feature.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = feature.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # same order, so one pass gives both
    n_left, s_left = F.sum("_w").over(up_to), F.sum("_s").over(up_to)
    sides = sums.select(*keys, "_at", "f", "b", n_left.alias("nl"), s_left.cast("double").alias("sl"),
                        (F.sum("_w").over(whole) - n_left).alias("nr"),
                        (F.sum("_s").over(whole) - s_left).cast("double").alias("sr"))
    able = sides.where((F.col("nl") >= min_rows) & (F.col("nr") >= min_rows))
    both = F.col("sl") + F.col("sr")
    gain = F.expr("sl * sl / nl + sr * sr / nr") - both * both / (F.col("nl") + F.col("nr"))
    best = able.groupBy(*keys, "_at").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"))).alias("_m"))
    return best.where("_m.gain > 0").select(
        *keys, F.floor(F.col("_at") / n_nodes).cast("int").alias("_tree"), (F.col("_at") % n_nodes).alias("_node"),
        (-F.col("_m.f")).cast("int").alias("f"), (-F.col("_m.b")).cast("int").alias("b"), F.col("_m.gain").alias("gain"))


def _packed(rows: DataFrame, keys: Sequence[str], n_trees: int, n_nodes: int, entry: Column, kind: str, name: str) -> DataFrame:
    """One row per key: for each tree an array with the entry of every node."""
    nodes = F.array(*[F.max(F.when(F.col("_node") == i, entry)) for i in range(n_nodes)])
    by_tree = rows.groupBy(*keys, "_tree").agg(nodes.alias("_nodes"))
    none = F.array(*[F.lit(None).cast(kind)] * n_nodes)
    return by_tree.groupBy(*keys).agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("_tree") == t, F.col("_nodes"))), none) for t in range(n_trees)]).alias(name))


def _grown(rows: DataFrame, keys: Sequence[str], residual: Column, n_trees: int, depth: int, min_rows: int, seed: int,
           sample: bool, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Grow ``n_trees`` trees per key side by side; their splits and leaves per key, and the splits as rows."""
    base = rows.withColumn("_r", F.round(residual * SCALE).cast("long"))
    splits: list[DataFrame] = []
    kept: DataFrame | None = None
    none = F.array(*[F.lit(None).cast(_SPLIT)] * (2**depth - 1))

    def placed(level: int) -> DataFrame:
        here = base if kept is None else base.join(kept, list(keys), "left")
        trees = F.array(*[none] * n_trees) if kept is None else F.coalesce("_splits", F.array(*[none] * n_trees))
        here = here.select(*keys, "_x", "_r", "_row", F.posexplode(trees).alias("_tree", "_s"))
        here = _drawn(here, seed) if sample else here.withColumn("_w", F.lit(1).cast("long"))
        here = here.withColumn("_node", F.lit(0))
        for _ in range(level):  # a step is plain column work, which compiles; a loop in a lambda does not
            here = here.withColumn("_split", F.get("_s", F.col("_node"))).withColumn(
                "_node", F.coalesce(_step(F.col("_node"), F.col("_split")), F.lit(0)))
        return here  # a filter on _node would repeat every step inside the next; never NULL, a join adds none

    for level in range(depth):
        tried = _tried(rows.sparkSession, n_trees, level, seed, share)
        splits.append(materialized(_best_splits(placed(level), keys, 2**depth, tried, min_rows), "splits"))
        every = reduce(DataFrame.unionByName, splits)
        kept = _packed(every, keys, n_trees, 2**depth - 1, F.struct("f", "b"), _SPLIT, "_splits")
        if n_trees > 1:  # packing many trees costs more than reading them; one tree is packed where it is used
            kept = materialized(kept, "trees")
    sums = placed(depth).groupBy(*keys, "_tree", "_node").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_r")).alias("_s"))
    value = F.col("_s").cast("double") / F.col("_n") / SCALE
    leaves = _packed(sums, keys, n_trees, 2 ** (depth + 1) - 1, value, "double", "_leaves")
    joined = leaves if kept is None else leaves.join(kept, list(keys), "left")
    given = F.array(*[none] * n_trees) if kept is None else F.coalesce("_splits", F.array(*[none] * n_trees))
    trees = F.transform(F.arrays_zip(given.alias("splits"), F.col("_leaves").alias("leaves")), lambda t: F.struct(
        t["splits"].alias("splits"), t["leaves"].alias("leaves")))
    return joined.select(*keys, trees.alias("_grown")), every if splits else None


def train_keyed(df: DataFrame, features: Sequence[str], label: str = "pm25", keys: Sequence[str] = ("sensor_id",),
                kind: str = "random_forest", n_trees: int | None = None, depth: int = 4, max_bins: int = 32,
                min_rows: int = 1, rate: float = 0.3, seed: int = 7,
                levels: Mapping[str, Sequence[float]] | None = None) -> KeyedTrees:
    """M3: a model per key. Without ``n_trees`` a forest has 20 trees and a boosted model 10.

    tree           one tree of all rows and features
    random_forest  ``n_trees`` trees, each on a Poisson sample of the rows; a node tries a third of the features
    gbt            ``n_trees`` trees one after the other, each on what the ones before left over, times ``rate``

    ``levels`` gives the bin edges of features with few, known values. Rows equal in all columns share their draws.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown model kind: {kind}; expected one of {KINDS}")
    keys, features = list(keys), list(features)
    n_trees = n_trees or (10 if kind == "gbt" else 20)
    usable = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).dropna(subset=keys)
    edges = materialized(_edges(usable, keys, features, max_bins, levels or {}), "edges")
    rows = usable.join(edges, keys).select(
        *keys, _bins(features).alias("_x"), F.col(label).cast("double").alias("_y"),
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in keys]).alias("_row"))
    rows = materialized(rows, "binned")
    table = edges.withColumn("_base", F.lit(0.0)).withColumn(
        "_trees", F.array().cast("array<struct<splits:array<struct<f:int,b:int>>,leaves:array<double>>>"))
    if kind != "gbt":
        n = 1 if kind == "tree" else n_trees
        share = (len(features) if kind == "tree" else max(1, -(-len(features) // 3)), len(features))
        grown, gains = _grown(rows, keys, F.col("_y"), n, depth, min_rows, seed, kind != "tree", share)
        table = table.drop("_trees").join(grown.withColumnRenamed("_grown", "_trees"), keys)
        return KeyedTrees(tuple(keys), tuple(features), depth, 1.0 / n, materialized(table, "models"), gains)
    sums = rows.groupBy(*keys).agg(F.sum(F.round(F.col("_y") * SCALE).cast("long")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    base = sums.select(*keys, (F.col("_s").cast("double") / F.col("_n") / SCALE).alias("_b"))
    table = materialized(table.drop("_base").join(base.withColumnRenamed("_b", "_base"), keys), "models")
    gains = []
    for t in range(n_trees):
        so_far = rows.join(table.select(*keys, "_base", "_trees"), keys)
        residual = F.col("_y") - (F.col("_base") + F.lit(rate) * _total(depth))
        left_over = so_far.select(*keys, "_x", "_row", residual.alias("_left"))
        grown, found = _grown(left_over, keys, F.col("_left"), 1, depth, min_rows, seed, False, (len(features), len(features)))
        gains.append(found.withColumn("_tree", F.lit(t)))
        table = materialized(table.join(grown, keys).withColumn("_trees", F.concat("_trees", "_grown")).drop("_grown"), "models")
    return KeyedTrees(tuple(keys), tuple(features), depth, rate, table, reduce(DataFrame.unionByName, gains))
