"""Near-duplicate groups by SuperMinHash, banding, verification and union-find (operator 2).

1. Every text gives its set of distinct word shingles (A-Z lower-cased), a 64-bit digest of the set, a signature of
   ``BANDS * ROWS`` SuperMinHash registers, ``BANDS`` bucket keys and one byte of each register. Texts with the same
   digest are one class; from here on a class is one node, however many copies it has.
2. Buckets with two classes or more are kept. In each, the class that shares most bucket places is the centre and is
   paired with the others. A pair is verified on the full sets, which are made again from the two texts.
3. Buckets that still hold more than one component may hide links between members that are not the centre. For these
   the classes' shared shingles are counted: two sets can only be similar enough if enough shingles of each occur
   elsewhere too. What passes that bound and the signature estimate, over blocks of a bucket, is verified as well.
4. Links become components.

A pair with similarity s shares no bucket with probability (1 - s^5)^24: 8e-7 at 0.85. The estimate over 120
registers must reach ``threshold - SLACK``; with independent registers a pair at 0.85 fails that with probability
1.5e-7, less than by banding. Digests and shingles are
64-bit hashes; two different sets among n meet in one digest with probability n^2 / 2^65.

Defined results: null or empty texts and texts without words have no shingles, are linked with nothing and are kept.
A text of one to four words is one shingle. Rows that repeat an id are judged by their own text; a null id is never
the least id of a group unless all are null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazeline.llm.bits import bit_table, in_table
from hazeline.llm.components import components
from hazeline.llm.names import unused
from hazeline.llm.spans import U64, mixed, shingle_sets, slices
from hazeline.llm.superminhash import signatures
from hazeline.session import materialized

BANDS, ROWS = 24, 5
BLOCK = 256
SLACK = 0.19
_FOLD = U64(0xD6E8FEB86659FD93)
_SALT = U64(0x5851F42D4C957F2D)


def _digests(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(elements) + 1, U64)
    np.cumsum(mixed(elements ^ _SALT), out=sums[1:])
    sizes = np.diff(bounds).astype(U64)
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes * _SALT).view(np.int64)


def _featured(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = batch.columns
            for first, end, data, at in slices(texts):
                elements, bounds = shingle_sets(data, at, k)
                regs = signatures(elements, bounds, BANDS * ROWS)
                folded = regs[:, ::ROWS] + np.arange(BANDS, dtype=U64) * _SALT
                for j in range(1, ROWS):
                    folded = mixed(folded) * _FOLD + regs[:, j::ROWS]
                sizes = np.diff(bounds)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(mixed(folded).view(np.int64).reshape(-1)), BANDS)
                sketch = np.ascontiguousarray((mixed(regs) & U64(0xFF)).astype(np.uint8))
                width = BANDS * ROWS
                sketches = pa.Array.from_buffers(pa.binary(width), len(sketch), [None, pa.py_buffer(sketch)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), keys.slice(first, end - first), pa.array(sizes, pa.int64()),
                     pa.array(_digests(elements, bounds), mask=sizes == 0), bands.cast(pa.list_(pa.int64())),
                     sketches.cast(pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"])
    return run


def features(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row for each row of docs: id, key of the text, size and digest of its shingle set, buckets and sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _featured(k), f"doc_id {kind}, text_key bigint, n_shingles bigint, node bigint, bands array<bigint>, sketch binary")


def _verified(percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            step = 400
            for i in range(0, len(a), step):
                sets = []
                for column in (left, right):
                    mine = []
                    for _, _, data, at in slices(column.slice(i, step)):
                        elements, bounds = shingle_sets(data, at, k)
                        mine += np.split(elements, bounds[1:-1])
                    sets.append(mine)
                same = []
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.slice(i, step).filter(keep), b.slice(i, step).filter(keep)], ["a", "b"])
    return run


def verified(pairs: DataFrame, nodes: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """Pairs (a, b) of nodes whose full shingle sets reach the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = nodes.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
            .mapInArrow(_verified(percent, k), "a bigint, b bigint"))


def _alike(percent: int):
    """Rows of one block pair of a bucket in, pairs that may be links out, each in the first bucket that it shares."""
    least = max(0.0, percent / 100 - SLACK)

    def run(table: pa.Table) -> pa.Table:
        node, comp, size, shared, side = (table[c].to_numpy() for c in ("node", "comp", "n", "shared", "side"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        bucket = table["bucket"][0].as_py()
        rows = np.flatnonzero(side == 0)
        cols = np.flatnonzero(side == 1) if side.any() else rows
        found = []
        for i in rows:
            others = cols[comp[cols] != comp[i]] if cols is not rows else cols[(comp[cols] != comp[i]) & (node[cols] > node[i])]
            both = np.minimum(shared[i], shared[others])
            others = others[100 * both >= percent * (size[i] + size[others] - both)]
            if len(others):
                near = (sketch[others] == sketch[i]).mean(axis=1) >= least
                near &= bands[i][(bands[others] == bands[i]).argmax(axis=1)] == bucket
                found += [(node[i], node[j]) for j in others[near]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": np.minimum(pairs[:, 0], pairs[:, 1]), "b": np.maximum(pairs[:, 0], pairs[:, 1])})
    return run


def _close(percent: int):
    least = max(0.0, percent / 100 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def _centre_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    sized = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")
    weight = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("c"))
    pairs = (members.join(centre, "bucket").where("node <> c")
             .select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct())
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .select("a", "b", "sa", "sb").mapInArrow(_close(percent), "a bigint, b bigint"))


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for first, end, data, at in slices(batch.column(1)):
                elements, bounds = shingle_sets(data, at, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[first:end], np.diff(bounds))), pa.array(elements.view(np.int64))],
                    ["node", "shingle"])
    return run


def _residual_pairs(members: DataFrame, nodes: DataFrame, first: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs that the centres did not decide: same bucket, different component, similar enough by both bounds."""
    labelled = members.join(first, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    unsettled = (labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo <> hi").select("bucket"))
    left = materialized(labelled.join(unsettled, "bucket"), "residual")
    texts = nodes.join(left.select("node").distinct(), "node")
    alone = (texts.select("node", "text").mapInArrow(_shingled(k), "node bigint, shingle bigint").groupBy("shingle")
             .agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
             .groupBy("node").agg(F.count("*").alias("alone")))
    able = materialized(
        texts.select("node", "n", "sketch", "bands").join(alone, "node", "left")
        .withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
        .where(F.col("shared") * 100 >= percent * F.col("n")).select("node", "n", "shared", "sketch", "bands"), "able")
    rows = left.join(able.select("node"), "node")
    sizes = (rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo <> hi").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")))
    blocks = (rows.join(sizes, "bucket").withColumn("p", F.pmod(F.hash("node"), F.col("parts")))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("bucket", "node", "comp", F.least("p", "other").alias("i"), F.greatest("p", "other").alias("j"),
                      F.when(F.col("p") > F.col("other"), 1).otherwise(0).alias("side"))
              .join(able, "node"))
    return blocks.groupBy("bucket", "i", "j").applyInArrow(_alike(percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    made = materialized(features(docs, k), "features")
    known = made.where("node is not null")
    places = known.select("node", F.explode("bands").alias("bucket"))
    crowded = (places.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
               .select("bucket"))
    members = materialized(places.join(crowded, "bucket").select("bucket", "node").distinct(), "members")
    sketches = (known.select("node", "n_shingles", "text_key", "sketch", "bands").join(members.select("node").distinct(), "node")
                .groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("text_key").alias("text_key"),
                                     F.min("sketch").alias("sketch"), F.min("bands").alias("bands")))
    sketches = materialized(sketches, "sketches")
    table = materialized(bit_table(sketches, "text_key"), "bits").scalar()
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").where(in_table(F.col("text_key"), table))
    nodes = materialized(sketches.join(
        texts.join(sketches.select("node", "text_key"), "text_key").groupBy("node").agg(F.min("text").alias("text")),
        "node"), "nodes")
    links = materialized(verified(_centre_pairs(members, nodes, percent), nodes, percent, k), "links")
    open_pairs = materialized(_residual_pairs(members, nodes, components(links), percent, k), "pairs")
    roots = components(links.unionAll(verified(open_pairs, nodes, percent, k)))
    classes = known.groupBy("node").agg(F.min("doc_id").alias("lowest"))
    labels = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = labels.groupBy("root").agg(F.min("lowest").alias("component_id"))
    labels = labels.join(lowest, "root").select("node", "component_id")
    linked = known.join(labels, "node").select("doc_id", "n_shingles", "component_id")
    alone = made.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """The rows of docs that stay, with their own columns: all rows without words, and one row of each group.

    Rows are told apart by id and text, so that repeated ids do not bring a removed text back.
    """
    both = F.struct("doc_id", F.xxhash64("text").alias("key"))
    found = near_duplicates(docs.select(both.alias("doc_id"), "text"), percent, k)
    mine, other, key = unused(docs.columns, "__key", "__id", "__of")
    stay = found.where("kept and n_shingles > 0").select("doc_id").distinct().select(
        F.col("doc_id.doc_id").alias(other), F.col("doc_id.key").alias(key))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumn(mine, F.xxhash64("text"))
    first = (keyed.where(words).join(stay, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(mine) == F.col(key)), "left_semi")
             .dropDuplicates(["doc_id", mine]).select(docs.columns))
    return first.unionAll(docs.where(~words))
