"""Exact repeats of ``LENGTH`` bytes across all texts by merged Burrows-Wheeler transforms (operator 7).

A string that repeats holds the same least window of ``GRAM`` bytes (by hash) at the same offset wherever it starts.
So starts are grouped by that window, their key, and only texts of the same key are ever compared:

1. Keys that have one place in the corpus cannot hold a repeat. (Places are named by text, so that whole copies of a
   text count once.)
2. Starts of the other keys form blocks of at most ``BLOCK`` starts, cut by their offset to the key's window. All strings
   of a block share a core of LENGTH - BLOCK + 1 bytes. Blocks are counted by core and content: equal blocks at two places
   are repeats at once, however many there are. What remains are cores with several contents, which occur where shared
   passages begin and end.
3. There, a content is its few bytes before the core, one symbol for the core, and the few after it. Tasks merge the
   transforms of shards of these strings (``bwt``): classes of suffixes with a common prefix of BLOCK symbols are strings
   of LENGTH equal bytes. A core with more than ``MOST_CONTENTS`` contents would make one task large; the strings of such
   cores are counted by their hash instead, which gives the same answer split over all tasks.
4. Repeated starts become byte spans of each text; texts that occur twice as a whole are covered from end to end.

Keys are compared by 64-bit, cores, contents and texts by 128-bit hashes.

Defined results: a null text is the empty text; texts shorter than LENGTH bytes keep all. Texts are told apart by two
64-bit hashes. Rows that repeat a text are copies, also if they repeat the id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazeline.llm.bits import bit_table, in_table
from hazeline.llm.bwt import repeated_starts
from hazeline.llm.spans import RAW_VALUES, U64, mixed, powers, slices
from hazeline.session import materialized

LENGTH, GRAM, BLOCK = 200, 64, 32
CORE = b"\xff"  # no byte of UTF-8
MOST_CONTENTS = 4096
KEY_BITS = 1 << 25
BATCH_BYTES = 500_000
SLICE_BYTES = 250_000  # the arrays of a slice stay in the processor's cache
PIECE = 8_000_000
_OTHER_VALUES = mixed(RAW_VALUES ^ U64(0x94D049BB133111EB))
_LOW = U64(0xFFFFFF)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _ranges(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = powers(len(sums))[1]
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, U64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


class Chunks:
    """Runs of starts of one key in some texts, and their blocks."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        starts = np.arange(len(data) - LENGTH + 1)
        row = np.searchsorted(at, starts, "right") - 1
        keep = starts + LENGTH <= at[row + 1]
        self.sums = _sums(RAW_VALUES[data])
        places = np.arange(len(data) - GRAM + 1)
        hashes = _ranges(self.sums, places, places + GRAM)
        least = _least((hashes & ~_LOW) | places.astype(U64), LENGTH - GRAM + 1)
        which = (least & _LOW).astype(np.int64)[keep]
        starts, row = starts[keep], row[keep]
        first = np.ones(len(starts), bool)
        first[1:] = (which[1:] != which[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        self.data, self.at = data, at
        self.count = np.diff(np.append(begin, len(starts)))
        self.row, self.begin, self.least = row[begin], starts[begin], which[begin]
        self.key = hashes[self.least].view(np.int64)

    def blocks(self, keep: np.ndarray) -> dict[str, np.ndarray]:
        """Blocks of the runs to keep: row, first and last start, bounds of the core, and hashes of core and content."""
        begin, count, least, row = self.begin[keep], self.count[keep], self.least[keep], self.row[keep]
        high, low = (least - begin) // BLOCK, (least - begin - count + 1) // BLOCK
        number = high - low + 1
        run = np.repeat(np.arange(len(begin)), number)
        step = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number))
        core = least[run] - BLOCK * step
        first = np.maximum(begin[run], core - BLOCK + 1)
        last = np.minimum(begin[run] + count[run] - 1, core)
        end = core + LENGTH - BLOCK + 1
        other = _sums(_OTHER_VALUES[self.data])
        return {"row": row[run], "first": first, "last": last, "core": core, "end": end,
                "key": _ranges(self.sums, core, end).view(np.int64), "key2": _ranges(other, core, end).view(np.int64),
                "h1": _ranges(self.sums, first, last + LENGTH).view(np.int64),
                "h2": _ranges(other, first, last + LENGTH).view(np.int64)}


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, place of each text's first byte here) of texts; very long ones come in pieces."""
    for first, end, data, at in slices(texts, SLICE_BYTES):
        if len(data) <= PIECE:
            if len(data) >= LENGTH:
                yield first, data, at, np.zeros(end - first, np.int64)
        else:  # one long text: pieces overlap, so that each start lies in one piece
            for a in range(0, len(data) - LENGTH + 1, PIECE):
                part = data[a: a + PIECE + LENGTH - 1]
                yield first, part, np.array([0, len(part)]), np.array([a])


def _passed(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = key.view(U64) & U64(KEY_BITS - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def _emitted(shared, what: str, cores=None):
    """Rows of the texts of a task, of each text once: keys, or blocks of keys in a table as hashes, or the bytes around
    the cores in a second table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared else None
        done: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            fresh = []
            for pair in zip(k1.tolist(), k2.tolist()):
                fresh.append(pair not in done)
                if len(done) < 500_000:
                    done.add(pair)
            texts = batch.column(2).filter(pa.array(fresh))
            k1, k2 = k1[fresh], k2[fresh]
            for first, data, at, shift in _pieces(texts):
                c = Chunks(data, at)
                if bits is None:
                    a, b = k1[first + c.row], k2[first + c.row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.key), pa.array(_tags(a, b, c.begin - at[c.row] + shift[c.row]))], ["key", "tag"])
                    continue
                keep = _passed(c.key, bits)
                if not keep.any():
                    continue
                x = c.blocks(keep)
                if cores:
                    open_ = _passed(x["key"], cores.value)
                    x = {name: values[open_] for name, values in x.items()}
                a, b = k1[first + x["row"]], k2[first + x["row"]]
                place = x["first"] - at[x["row"]] + shift[x["row"]]
                columns = [pa.array(v) for v in (x["key"], x["key2"], x["h1"], x["h2"], _tags(a, b, place), a, b, place,
                                                 x["last"] - x["first"] + 1)]
                names = ["key", "key2", "h1", "h2", "tag", "k1", "k2", "place", "count"]
                if what == "bytes":
                    raw = data.tobytes()
                    bounds = zip(*(x[n].tolist() for n in ("first", "core", "end", "last")))
                    columns.append(pa.array([raw[f:s] + CORE + raw[e: t + LENGTH] for f, s, e, t in bounds], pa.binary()))
                    names.append("content")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _tags(k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(k1.view(U64) ^ mixed(place.astype(U64) + k2.view(U64))).view(np.int64)


CORES = ["key", "key2"]
ROWS = "key bigint, key2 bigint, h1 bigint, h2 bigint, tag bigint, k1 bigint, k2 bigint, place bigint, count bigint"


def _bits(keys: DataFrame):
    """A broadcast bit table of keys: KEY_BITS bits, whatever their number."""
    at = F.col("key").bitwiseAND(KEY_BITS - 1)
    set_ = (keys.select(F.shiftright(at, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits"))).toArrow()
    table = np.zeros(KEY_BITS // 64, U64)
    table[set_["at"].to_numpy()] = set_["bits"].to_numpy().view(U64)
    return keys.sparkSession.sparkContext.broadcast(table)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents sorted by key in, their repeated starts out as (k1, k2, from, to) spans; keys are never parted."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(rows: pa.Table) -> pa.RecordBatch:
        contents = rows["content"].to_pylist()
        parts = [np.diff(rows[c].to_numpy()) != 0 for c in CORES]
        owner = np.concatenate([[0], np.cumsum(parts[0] | parts[1])])
        flags = repeated_starts(contents, BLOCK, owner=owner)
        place = rows["place"].to_numpy()
        out = []
        for r, flag in enumerate(flags):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
            out += [(r, place[r] + a, place[r] + b - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2])]
        found = np.array(out, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["k1"].to_numpy()[found[:, 0]]), pa.array(rows["k2"].to_numpy()[found[:, 0]]),
             pa.array(found[:, 1]), pa.array(found[:, 2])], ["k1", "k2", "from", "to"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        start = 0
        for cut in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
            last = held[-1].column(0)[-1].as_py() if held else None
            if size >= BATCH_BYTES and start < len(keys) and last != keys[start]:
                yield settle(pa.Table.from_batches(held))
                held, size = [], 0
            part = batch.slice(start, cut - start)
            if part.num_rows:
                held.append(part)
                size += part.column(batch.schema.names.index("content")).nbytes
            start = cut
    if held:
        yield settle(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the contents as two hashes, mixed with those of their core."""
    for batch in batches:
        names = batch.schema.names
        for i, content in enumerate(batch.column(names.index("content")).to_pylist()):
            data = np.frombuffer(content, np.uint8)
            begin = np.arange(len(data) - BLOCK + 1)
            key, key2, k1, k2, place = (batch.column(names.index(c))[i].as_py() for c in (*CORES, "k1", "k2", "place"))
            h1, h2 = (mixed(_ranges(_sums(v[data]), begin, begin + BLOCK) ^ np.int64(core).view(U64)).view(np.int64)
                      for v, core in ((RAW_VALUES, key), (_OTHER_VALUES, key2)))
            n = len(begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(begin + place)],
                ["h1", "h2", "k1", "k2", "from"])


def repeats(docs: DataFrame, most_contents: int = MOST_CONTENTS) -> DataFrame:
    """(k1, k2, from, to): byte spans of the texts named by (k1, k2) that repeated strings cover; spans may overlap."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    keys = (named.mapInArrow(_emitted(None, "keys"), "key bigint, tag bigint").groupBy("key")
            .agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key"))
    bits = _bits(materialized(keys, "keys"))
    blocks = materialized(named.mapInArrow(_emitted(bits, "hashes"), ROWS), "blocks")
    contents = materialized(blocks.groupBy(*CORES, "h1", "h2").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")), "contents")
    many = contents.where("lo <> hi").select(*CORES, "h1", "h2")
    at_once = blocks.join(many, [*CORES, "h1", "h2"], "left_semi").select(
        "k1", "k2", F.col("place").alias("from"), (F.col("place") + F.col("count") + LENGTH - 1).alias("to"))
    open_cores = materialized(contents.groupBy(*CORES).agg(F.count("*").alias("contents")).where("contents > 1"), "open")
    one_each = F.struct("tag", "k1", "k2", "place", "content")
    rows = (named.mapInArrow(_emitted(bits, "bytes", _bits(open_cores)), ROWS + ", content binary")
            .groupBy(*CORES, "h1", "h2").agg(F.min(one_each).alias("one")).join(open_cores, CORES)
            .select(*CORES, "contents", "one.k1", "one.k2", "one.place", "one.content"))
    rows = materialized(rows, "rows")
    few = (rows.where(F.col("contents") <= most_contents).drop("contents").repartition(*CORES).sortWithinPartitions(*CORES)
           .mapInArrow(_resolved, "k1 bigint, k2 bigint, from bigint, to bigint"))
    windows = rows.where(F.col("contents") > most_contents).drop("contents").mapInArrow(
        _windows, "h1 bigint, h2 bigint, k1 bigint, k2 bigint, from bigint")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    crowded = windows.join(twice, ["h1", "h2"], "left_semi").select("k1", "k2", "from", (F.col("from") + LENGTH).alias("to"))
    size = F.octet_length("text").cast("long")
    whole = (named.select("k1", "k2", size.alias("to")).where(F.col("to") >= LENGTH).groupBy("k1", "k2")
             .agg(F.count("*").alias("n"), F.max("to").alias("to")).where("n > 1")
             .select("k1", "k2", F.lit(0).cast("long").alias("from"), "to"))
    return at_once.unionAll(few).unionAll(crowded).unionAll(whole)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and its sorted spans in; counts and the digest of what stays out."""
    for batch in batches:
        counts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode()
            kept, at, runs = [], 0, 0
            for span in spans or ():
                if span["from"] > at or not runs:
                    kept.append(data[at: span["from"]])
                    runs += 1
                at = max(at, span["to"])
            kept.append(data[at:])
            left = b"".join(kept)
            counts.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*counts)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, most_contents: int = MOST_CONTENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs (doc_id, text)."""
    spans = repeats(docs, most_contents).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    spans = materialized(spans, "spans")
    table = materialized(bit_table(spans.select("k1"), "k1"), "bits").scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    touched = in_table(F.col("k1"), table)
    none: Column = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    cut = keyed.where(touched).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, out)
    return cut.unionAll(keyed.where(~touched).select("doc_id", "text", none).mapInArrow(_cut, out))
