"""Quality by the perplexity of an interpolated modified Kneser-Ney model (operator 9).

The model is over code points, with no fixed alphabet: n-grams of ``ORDER`` code points of all trusted texts are
counted. Counts, continuation counts, context sums and back-off weights are tables sharded by n-gram, and nothing of
them but the counts of counts and the sums of single signs comes to the driver. A table of the cost of every n-gram that
occurs in any text is made by joins from short n-grams to long ones, and packed by shard: n-grams in order, as compressed
steps. Texts are held in slices of about ``SLICE_BYTES``, each with its distinct n-grams packed in the same way. A slice
sends one packed row to each shard. A shard's rows stream past its costs, sorted by shard, and go back to their slice,
where they are summed by text. So a frequent n-gram costs some bytes a slice, not a row a text. Shards grow in number with the n-grams, and
the slices of a shard are dealt to groups, so no task holds more than one shard's costs and one slice. Costs are sent as
32-bit floats. Thresholds are a quantile of the perplexity of the trusted texts of each language, plus a margin.

Trusted are texts whose label says quality 1. All of them are counted. Signs never seen share the mass that single signs
leave over, spread over all ``CODE_POINTS``.

Defined results: null and empty texts have no perplexity and are not kept; texts of fewer than ``MIN_CHARS`` characters
are not judged and are kept. A language with fewer than ``MIN_TRUSTED`` trusted texts takes the threshold of all
languages; without any trusted text everything is kept. Null languages are one language. Null labels are no labels;
a repeated id is trusted if one of its labels is. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hazeline.llm.spans import slices
from hazeline.session import materialized

ORDER = 4
QUANTILE, MARGIN = 0.99, 1.25
MIN_CHARS, MIN_TRUSTED = 100, 20
CODE_POINTS = 0x110000
SLICE_BYTES = 4_000_000
SLICE_ROWS = 30_000  # places of texts in a slice are 16-bit integers
SHARD_GRAMS = 65_536  # about so many n-grams share a shard of the costs
GROUP_SLICES = 4_096  # a shard's costs are repeated for each group of so many slices
PRIME, MIX = 2_147_483_647, (1_000_003, 1_299_709_411, 15_485_863, 179_424_673)  # weights of signs in the shard of an n-gram
KEYS = [f"k{j}" for j in range(ORDER)]  # signs of an n-gram, the last one first


def point_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, bounds of the texts) of consecutive rows of about ``SLICE_BYTES``."""
    for first, end, data, at in slices(column, SLICE_BYTES):
        for a in range(first, end, SLICE_ROWS):
            b = min(end, a + SLICE_ROWS)
            raw, bounds = data[at[a - first]: at[b - first]], at[a - first: b - first + 1] - at[a - first]
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            yield a, b, points, np.searchsorted(lead, bounds)


def _numbered(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and the place of each code among them; codes are below ``bound``."""
    if bound > 2 * len(codes) + (1 << 22):
        found, place = np.unique(codes, return_inverse=True)
        return found, place.astype(np.int32)
    seen = np.zeros(bound, bool)
    seen[codes] = True
    found = np.flatnonzero(seen)
    place = np.zeros(bound, np.int32)
    place[found] = np.arange(len(found))
    return found, place[codes]


def point_grams(points: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the n-gram that ends at each sign, and the n-grams by number, in order (signs, the last one first).

    Texts start after line ends. Numbers are those of the slice; they stand for the signs themselves, not for hashes.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int32), np.zeros((0, ORDER), np.int64)
    seen = np.zeros(CODE_POINTS, bool)
    seen[points] = True
    seen[ord("\n")] = True
    signs = np.flatnonzero(seen)
    place_of = np.zeros(CODE_POINTS, np.int32)
    place_of[signs] = np.arange(len(signs))
    local, edge = place_of[points], place_of[ord("\n")]
    width, lengths = len(signs), np.diff(of)
    number, parts = local, signs[:, None]
    for j in range(1, ORDER):
        codes = number.astype(np.int64) * width
        before = np.full(n, edge)
        before[j:] = local[: max(0, n - j)]
        for i in range(j):  # the first signs of a text have none before them
            before[of[:-1][lengths > i] + i] = edge
        codes += before
        found, number = _numbered(codes, len(parts) * width)
        parts = np.concatenate([parts[found // width], signs[found % width][:, None]], axis=1)
    return number, parts


def _gram_columns(parts: np.ndarray) -> list[pa.Array]:
    return [pa.array(parts[:, j].astype(np.int32), pa.int32()) for j in range(ORDER)]


def _texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a slice and how many each text has."""
    texts = [text or "" for text in rows["text"].to_pylist()]
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(text) for text in texts], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of the named texts of each slice and their counts."""
    for batch in batches:
        for body, which in zip(batch.column(0), batch.column(1)):
            rows = pa.ipc.open_stream(body.as_py()).read_all()
            points, n = _texts(rows.take(which.values))
            if len(points):
                number, parts = point_grams(points, np.concatenate([[0], np.cumsum(n)]))
                times = np.bincount(number, minlength=len(parts))
                yield pa.RecordBatch.from_arrays([*_gram_columns(parts), pa.array(times, pa.int64())], [*KEYS, "c"])


def _pressed(values: np.ndarray) -> bytes:
    """4-byte values, like bytes beside each other, compressed after their number."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _opened(body: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(body[:4], "little")
    raw = pa.Codec("zstd").decompress(body[4:], 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(kind).reshape(-1)


def _coded(parts: np.ndarray) -> bytes:
    """N-grams in order as steps from one to the next, sign by sign."""
    return _pressed(np.diff(parts.astype(np.int32), axis=0, prepend=np.zeros((1, ORDER), np.int32)).T.reshape(-1))


def _decoded(body: bytes) -> np.ndarray:
    return np.cumsum(_opened(body, np.int32).reshape(ORDER, -1), axis=1, dtype=np.int64).T


def _cut(parts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by shard, in order within each, and the bounds of the shards."""
    shard = (parts @ np.array(MIX)) % PRIME % shards
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _sliced(kind: pa.DataType):
    """One row for each slice of texts: its name, its ids, its rows packed, and its n-grams packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, points, of in point_slices(batch.column(2)):
                own = batch.slice(first, end - first)
                own = pa.RecordBatch.from_arrays([own.column(0).cast(kind), own.column(1).cast(pa.string()), own.column(2).cast(pa.large_string())],
                                                 ["doc_id", "lang", "text"])
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + serial]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(0)),
                     pa.array([sink.getvalue().to_pybytes()]), pa.array([_coded(point_grams(points, of)[1])])],
                    ["slice", "ids", "rows", "grams"])
                serial += 1
    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each slice."""
    for batch in batches:
        for body in batch.column(0):
            yield pa.RecordBatch.from_arrays(_gram_columns(_decoded(body.as_py())), KEYS)


def _asked(shards: int, groups: int):
    """The n-grams of each slice packed by shard of the costs; slices are dealt to groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = _decoded(body.as_py())
                order, at = _cut(parts, shards)
                held = np.flatnonzero(np.diff(at))
                group = ((name >> 32) * 31 + (name & 0xFFFFFFFF)) % groups
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.astype(np.int32)), pa.array([group] * len(held), pa.int32()), pa.array([name] * len(held), pa.int64()),
                     pa.array([_coded(parts[order[at[s]: at[s + 1]]]) for s in held], pa.binary()),
                     pa.array([b""] * len(held), pa.binary())], ["shard", "group", "slice", "grams", "bits"])
    return run


def _shelved(table: pa.Table) -> pa.Table:
    """The costs of a shard as one row."""
    parts = np.stack([table[k].to_numpy() for k in KEYS], axis=1)
    order = np.lexsort(parts.T[::-1])
    return pa.table([table["shard"][:1], pa.array([_coded(parts[order])]),
                     pa.array([_pressed(table["bits"].to_numpy()[order].astype(np.float32))])], ["shard", "grams", "bits"])


def _head_and_tail(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (parts[:, 0] << 21) | parts[:, 1], (parts[:, 2] << 21) | parts[:, 3]


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs of each packed row's n-grams; the rows of a shard follow the row that holds its costs."""
    heads = codes = bits = None
    for batch in batches:
        names, shards, bodies = [], [], []
        for shard, name, grams, held in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
            head, tail = _head_and_tail(_decoded(grams.as_py()))
            if name.as_py() < 0:
                heads, place = np.unique(head, return_inverse=True)
                codes, bits = (place.astype(np.int64) << 42) | tail, _opened(held.as_py(), np.float32)
                continue
            names.append(name.as_py())
            shards.append(shard.as_py())
            bodies.append(_pressed(bits[np.searchsorted(codes, (np.searchsorted(heads, head) << 42) | tail)]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(shards, pa.int32()), pa.array(bodies, pa.binary())],
                                         ["slice", "shard", "body"])


def _summed(kind: pa.DataType, shards: int):
    """Perplexity of the texts of a slice from its rows and the costs of its n-grams."""
    def run(table: pa.Table) -> pa.Table:
        bodies = dict(zip(table["shard"].to_pylist(), table["body"]))
        own = pa.ipc.open_stream(bodies.pop(-1).as_py()).read_all()
        points, n = _texts(own)
        number, parts = point_grams(points, np.concatenate([[0], np.cumsum(n)]))
        order, at = _cut(parts, shards)
        bits = np.full(len(parts), np.nan)
        for shard, body in bodies.items():
            bits[order[at[shard]: at[shard + 1]]] = _opened(body.as_py(), np.float32)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), weights=bits[number], minlength=len(n))
        return pa.table([own["doc_id"].cast(kind), own["lang"], pa.array(n, pa.int64()),
                         pa.array(np.exp2(sums / np.maximum(n, 1)), pa.float64(), mask=n == 0)],
                        ["doc_id", "lang", "n_chars", "perplexity"])
    return run


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more by Chen and Goodman's formula; usual values where counts are missing."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.get(i) for i in (1, 2, 3, 4)):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]


def levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: share of every seen n-gram after discounting (signs, own), and back-off weights of the
    contexts (signs before the last, back)."""
    counted = [counts]
    for order in range(ORDER - 1, 0, -1):  # in how many ways a shorter n-gram is continued to the left
        counted.append(materialized(counted[-1].groupBy(KEYS[:order]).agg(F.count("*").alias("c")), "grams"))
    out = []
    for order, rows in enumerate(reversed(counted), 1):
        d = _discounts(rows)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = KEYS[1:order]
        if not context:
            total, spared = rows.agg(F.sum("c"), F.sum(off)).first()
            shares = rows.select("k0", ((F.col("c") - off) / total).alias("own"))
            backs = rows.sparkSession.range(1).select(F.lit(spared / total).alias("back"))
        else:
            sums = materialized(rows.groupBy(context).agg(F.sum("c").alias("total"), F.sum(off).alias("spared")), "contexts")
            shares = rows.join(sums, context).select(*KEYS[:order], ((F.col("c") - off) / F.col("total")).alias("own"))
            backs = sums.select(*context, (F.col("spared") / F.col("total")).alias("back"))
        out.append((shares, backs))
    return out


def costs(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """Cost in bits of every n-gram of ``wanted`` (distinct signs): signs and bits, whether the n-gram was seen or not."""
    asked = [wanted]
    for order in range(ORDER - 1, 0, -1):
        asked.append(materialized(asked[-1].select(KEYS[:order]).distinct(), "asked"))
    below = None
    for order, (rows, (shares, backs)) in enumerate(zip(reversed(asked), levels(counts)), 1):
        both = rows.join(shares, KEYS[:order], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
        if below is None:
            p = F.col("own") + F.lit(backs.first()[0] / CODE_POINTS)
        else:
            both = (both.join(backs, KEYS[1:order], "left").join(below.withColumnRenamed("p", "q"), KEYS[:order - 1]))
            p = F.col("own") + F.coalesce("back", F.lit(1.0)) * F.col("q")
        below = both.select(*KEYS[:order], p.alias("p"))
        if order < ORDER:
            below = materialized(below, "level")
    return below.select(*KEYS, (-F.log2("p")).alias("bits"))


def sliced(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, lang, text) in slices, written once: slice, ids, rows and grams."""
    field = docs.schema["doc_id"].dataType
    return materialized(docs.select("doc_id", "lang", "text").mapInArrow(
        _sliced(to_arrow_type(field)), f"slice bigint, ids array<{field.simpleString()}>, rows binary, grams binary"), "slices")


def counted(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """The n-grams of all texts whose doc_id is in ``trusted`` (distinct) and their counts.

    Only ids meet the trusted ids; each slice then learns which of its texts are trusted, two bytes a text. Where this
    table is small, slices are not shuffled for it; beyond Spark's broadcast threshold they are, packed.
    """
    ids = packed.select("slice", F.posexplode("ids").alias("at", "doc_id"))
    which = materialized(ids.join(trusted, "doc_id", "left_semi").groupBy("slice")
                         .agg(F.sort_array(F.collect_list(F.col("at").cast("smallint"))).alias("which")), "which")
    gram = ", ".join(f"{k} int" for k in KEYS)
    return (packed.select("slice", "rows").join(which, "slice").select("rows", "which")
            .mapInArrow(_counted, f"{gram}, c bigint").groupBy(KEYS).agg(F.sum("c").alias("c")))


def perplexities(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars and perplexity of each row in the slices of ``sliced``."""
    field = packed.schema["ids"].dataType.elementType
    kind, name = to_arrow_type(field), field.simpleString()
    gram = ", ".join(f"{k} int" for k in KEYS)
    wanted = materialized(packed.select("grams").mapInArrow(_unpacked, gram).distinct(), "wanted")
    shards = max(1, math.ceil(wanted.count() / SHARD_GRAMS))
    groups = max(1, math.ceil(packed.count() / GROUP_SLICES))
    shard = sum((F.col(k).cast("bigint") * m for k, m in zip(KEYS, MIX)), F.lit(0)) % PRIME % shards
    shelves = costs(wanted, counts).withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(
        _shelved, "shard int, grams binary, bits binary")
    # a shard's costs come before its slices, because no slice has a negative name
    shelves = shelves.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).cast("bigint").alias("slice"), "grams", "bits")
    asked = packed.select("slice", "grams").mapInArrow(
        _asked(shards, groups), "shard int, group int, slice bigint, grams binary, bits binary")
    answers = (asked.unionByName(shelves).repartition("shard", "group").sortWithinPartitions("shard", "group", "slice")
               .mapInArrow(_priced, "slice bigint, shard int, body binary"))
    return (packed.select("slice", F.lit(-1).alias("shard"), F.col("rows").alias("body")).unionByName(answers)
            .groupBy("slice").applyInArrow(_summed(kind, shards), f"doc_id {name}, lang string, n_chars bigint, perplexity double"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_chars, perplexity, threshold and kept for each row of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    trusted = materialized(trusted_ids(labels), "trusted")
    packed = sliced(docs)
    counts = materialized(counted(packed, trusted), "counts")
    if counts.head(1):
        scored = materialized(perplexities(packed, counts), "perplexity")
    else:
        n = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
        scored = docs.select("doc_id", "lang", n.alias("n_chars"), F.when(n > 0, float(CODE_POINTS)).alias("perplexity"))
    judged = scored.join(trusted, "doc_id", "left_semi").where(F.col("n_chars") >= MIN_CHARS)

    def limit(name: str) -> Column:
        return (F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin).alias(name)

    # one row for each language code; the codes are few, but nothing hangs on it
    by_language = judged.groupBy("lang").agg(F.count("*").alias("n"), limit("own")).where(F.col("n") >= MIN_TRUSTED)
    everywhere = judged.agg(limit("all")).scalar()
    out = scored.join(by_language.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    out = out.withColumn("threshold", F.coalesce("own", everywhere))
    kept = F.when(F.col("n_chars") < MIN_CHARS, F.col("n_chars") > 0).otherwise(
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select("doc_id", "n_chars", "perplexity", "threshold", kept.alias("kept"))
