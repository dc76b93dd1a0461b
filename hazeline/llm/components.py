"""Connected components of a link table as Spark joins, with a union-find inside each partition first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazeline.session import materialized

EDGE = "u bigint, v bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One edge from each node of the partition to the least node joined to it; memory: the nodes of the partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i: i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(find, part), pa.int64())], ["u", "v"])


def _stars(edges: DataFrame) -> DataFrame:
    """A large star and then a small star: each node's greater neighbours, then its lesser ones, move to its least."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
    lesser = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lesser, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lesser.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Linked nodes with the least node of their component: (node, root). Nodes without links are not listed.

    links: (a, b) longs; nulls and loops are ignored, repeats are harmless. Edges shrink to stars within O(log^2 n)
    rounds; every round is written to the shared folder, so that a lost executor repeats one round at most.
    """
    edges = links.selectExpr("greatest(a, b) u", "least(a, b) v").where("u <> v").mapInArrow(_forest, EDGE)
    edges = materialized(edges, "edges")
    size = ("count(1) n", "coalesce(sum(cast(hash(u, v) as bigint)), 0) s")
    before = edges.selectExpr(*size).first()
    for _ in range(most_rounds):
        if not before["n"]:
            break
        edges = materialized(_stars(edges), "edges")
        now = edges.selectExpr(*size).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.selectExpr("v node", "v root").distinct())
