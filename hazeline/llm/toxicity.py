"""Counterfactual-regularised toxicity classifier (operator 6).

A logistic model over the presence of words. Each labelled text also has a counterfactual in which identity terms are
swapped for others of their group; the training loss adds the squared change of the score between the two, so that a
term's mention alone does not move it. Weights are found by follow-the-regularised-leader steps with an L1 penalty,
which leaves most weights at zero, so that long texts do not add up small ones.

The model is fitted on a bounded sample, at most ``SAMPLE`` labelled rows chosen by a hash of their id, whose word
numbers come to the driver; scoring covers every text. Rows whose crc32(doc_id) mod 5 is 0 are never learned from.

Defined results: null and empty texts get the score of the intercept alone; without labelled rows all texts get the
prior 0.1. Labels that are null are left out, repeated ids count once with their highest label. A null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hazeline.llm.names import unused
from hazeline.llm.spans import BYTE_VALUES, range_hashes, slices

SAMPLE = 20_000
BUCKETS = 1 << 18
EPOCHS = 10
BATCH = 64

# Groups of identity terms that replace each other in a counterfactual.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("she", "he"), ("her", "his"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"), ("old", "young"), ("blind", "deaf", "disabled"),
    ("immigrant", "native"), ("immigrants", "natives"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos"),
)

IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


def word_numbers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of letters, digits and non-ASCII signs, A-Z lower-cased, and the run bounds of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = IS_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
    first[starts], last[ends] = inside[starts], inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return (range_hashes(BYTE_VALUES[data], begin, end) % BUCKETS).astype(np.int64), np.searchsorted(begin, at)


def _swaps() -> np.ndarray:
    """For each bucket the bucket that replaces it in a counterfactual."""
    other = np.arange(BUCKETS)
    for group in IDENTITY_TERMS:
        raw = [t.encode() for t in group]
        numbers, _ = word_numbers(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        other[numbers] = np.roll(numbers, -1)
    return other


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in slices(batch.column(1)):
            numbers, of = word_numbers(data, at)
            sets = [np.unique(numbers[a:b]).astype(np.int32) for a, b in zip(of[:-1], of[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sets, pa.list_(pa.int32()))],
                                             ["toxic", "words"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """toxic and the distinct word numbers of at most ``most`` labelled texts that are not held out."""
    chosen = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` short rows
    return rows.select(F.col("toxic").cast("int"), "text").mapInArrow(_numbered, "toxic int, words array<int>")


class Model:
    """Weights by bucket and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        numbers, of = word_numbers(data, at)
        heavy = np.flatnonzero(self.weights[numbers])
        row = np.searchsorted(of, heavy, "right") - 1
        pairs = np.unique(row * BUCKETS + numbers[heavy])
        sums = np.bincount(pairs // BUCKETS, self.weights[pairs % BUCKETS], len(at) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def fitted(sets: list[np.ndarray], labels: np.ndarray, penalty: float = 1.0, rate: float = 1.5, l1: float = 6.0) -> Model:
    """The model of these word sets and 0/1 labels; ``penalty`` weighs the counterfactual term."""
    n = len(sets)
    share = (labels.sum() + 0.1) / (n + 1)
    intercept = float(np.log(share / (1 - share)))
    z, squares = np.zeros(BUCKETS), np.zeros(BUCKETS)
    other = _swaps()
    swapped = other != np.arange(BUCKETS)
    order = np.random.default_rng(7).permutation(n)

    def weights(at: np.ndarray) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / ((1 + np.sqrt(squares[at])) / rate + 0.01)

    def step(at: np.ndarray, gradient: np.ndarray) -> None:
        before = weights(at)
        grown = np.sqrt(squares[at] + gradient ** 2)
        z[at] += gradient - (grown - np.sqrt(squares[at])) / rate * before
        squares[at] += gradient ** 2

    drift = 1.0
    for _ in range(EPOCHS if n else 0):
        for i in range(0, n, BATCH):
            rows = order[i: i + BATCH]
            sizes = np.array([len(sets[r]) for r in rows])
            if not sizes.sum():
                continue
            flat = np.concatenate([sets[r] for r in rows])
            at, which = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), sizes)
            now = weights(at)
            score = 1 / (1 + np.exp(-np.clip(np.bincount(owner, now[which], len(rows)) + intercept, -30, 30)))
            error = score - labels[rows]
            step(at, np.bincount(which, error[owner], len(at)))
            drift += float((error ** 2).sum())
            intercept -= 0.5 * float(error.sum()) / np.sqrt(drift)
            named = swapped[flat]
            if named.any():  # score change when identity terms are swapped
                terms = np.concatenate([flat[named], other[flat[named]]])
                sign = np.concatenate([-np.ones(named.sum()), np.ones(named.sum())])
                row = np.concatenate([owner[named], owner[named]])
                at, which = np.unique(terms, return_inverse=True)
                change = np.bincount(row, sign * weights(at)[which], len(rows))
                step(at, np.bincount(which, 2 * penalty * change[row] * sign, len(at)))
    return Model(weights(np.arange(BUCKETS)), intercept)


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, most).toArrow()
    return fitted([x.values.to_numpy() for x in rows["words"]], rows["toxic"].to_numpy().astype(float))


def _scored(shared, text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            at = batch.schema.names.index(text)
            parts = [model.scores(data, bounds) for _, _, data, bounds in slices(batch.column(at))]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, score], [*names, name])
    return run


def scored(rows: DataFrame, text: str, model: Model) -> tuple[DataFrame, str]:
    """rows with the score of the text column as the last column, and that column's name."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # BUCKETS numbers, whatever the corpus
    copy, score = unused(rows.columns, "__text", "__score")
    fields = StructType([*rows.schema.fields, StructField(score, DoubleType())])
    return rows.withColumn(copy, F.col(text)).mapInArrow(_scored(shared, copy, score), fields), score


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").alias("body"))
    found, score = scored(rows, "body", learned(docs, labels, most))
    return found.select("doc_id", "held_out", F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, original: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of docs that the model, learned from the original documents, does not call toxic."""
    found, score = scored(docs, "text", learned(original, labels, most))
    return found.where(F.col(score) < 0.5).drop(score)
