"""Cross-tokenizer alignment by external spill counting (operator 13).

Two tokenizers read the same bytes: A is a byte-level BPE (JSON), B a piece model with byte fallback that adds a space
in front. Where a token of A and one of B end at the same byte, a group ends; within a group every token of A is linked
with every token of B. A pair's count is the number of documents that hold it linked.

Texts are cut where neither tokenizer can join what stands on both sides, and each piece of text is encoded by the
libraries once per worker and remembered up to a bound. About SLICE bytes of text make a run: its distinct (pair,
document) records, ordered by radix of the A id, then A, then B, and packed as zstd blocks, one for each radix. The
blocks are written once as a table. Counting reads pairs and their document counts of each run only, brings the blocks of a radix
together and merges them by a heap of run cursors, one A id at a time: with an A id complete, the counts of its pairs
and their maximum are known, and every run that asked gets its pairs' counts back in its own order. A run then adds up
the contributions to its documents. A frequent pair is one record for each run, not for each document.

Defined results: null and empty texts, and texts of which the joined bytes of A or B differ from space and text, have
no tokens, zero counts and '' as groups. Rows are judged on their own, so repeated ids, null ids and equal texts stay
separate documents. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from hazeline.session import materialized

SLICE = 4_000_000
RADICES = 512
REMEMBERED = 400_000
# no piece of either vocabulary reaches over these places (checked for B when it is read; A's pattern splits there)
_LETTER_END = r"(?<=[^\W\d_])(?=\W)"
_WORD_END = r"(?<=[^\s▁])(?= )"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
RUN_SCHEMA = "run string, radix int, pairs binary, counts binary, postings binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes under zstd; high planes are mostly zero."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    planes = int(wide.any(axis=0).nonzero()[0].max(initial=0)) + 1
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide[:, :planes].T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(planes, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :planes] = raw.T
    return wide.view("<u8").ravel().astype(np.int64)


def _byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """The bytes of every token of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray, of: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray) -> np.ndarray:
        """For each piece, whether the bytes of its tokens (``of`` says whose) are its raw bytes."""
        sizes = self.sizes[ids]
        total = np.zeros(len(raw_sizes), np.int64)
        np.add.at(total, of, sizes)
        same = total == raw_sizes
        mine, own = same[of], np.repeat(np.arange(len(raw_sizes)), raw_sizes)
        spelled = self.data[_ranges(self.starts[ids[mine]], sizes[mine])]
        inside = same[own]
        same[own[inside][spelled != raw[inside]]] = False
        return same


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers starts[i] to starts[i] + sizes[i] - 1 for each i, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and the list that each is of."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum()), np.repeat(np.arange(len(lists)), sizes)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, and the remembered pieces of text."""

    def __init__(self, a_json: str, b_model: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        sign, entries = _byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(sign[c] for c in entry) if all(c in sign for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.spell_a, self.spell_b = TokenBytes(self.a_bytes), TokenBytes(self.b_bytes)
        self.names = [f"{i}{end}" for size, ends in ((len(self.a_bytes), ",|"), (self.b_size, ",;")) for end in ends for i in range(size)]
        text = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        joins = any("\n" in p or re.search(_LETTER_END, p.replace("▁", " ")) for p in text)
        rules = [_WORD_END] if joins else [_LETTER_END, _WORD_END]
        safe = not any(re.search("[^▁]▁", p) for p in text)
        self.cut = re.compile("|".join(rules)).split if safe else lambda whole: [whole]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.groups: list[str] = []  # each piece's groups, every one followed by ";"
        self.whole = np.zeros(0, bool)
        self.figures = np.zeros((0, 4), np.int64)
        self.ends = np.zeros(1, np.int64)  # where each piece's pairs end
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded_by_b(self, pieces: list[str]) -> list[list[int]]:
        # B adds a space in front of what is not empty. Where a piece does not begin with one, a line feed, which joins
        # with nothing, stands between that space and the piece.
        begins = [p[0] == " " and len(p) > 1 for p in pieces]
        spaced = iter(self.b.encode([p[1:] for p, b in zip(pieces, begins) if b], num_threads=1))
        inner = iter(self.b.encode(["\n" + p for p, b in zip(pieces, begins) if not b], num_threads=1))
        lead = len(self.b.encode("\n"))
        return [next(spaced) if b else next(inner)[lead:] for b in begins]

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces that are not known yet, all at once."""
        n = len(pieces)
        self.known.update(zip(pieces, range(len(self.groups), len(self.groups) + n)))
        self.held += sum(map(len, pieces))
        a, of_a = _flat([e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)])
        b, of_b = _flat(self._encoded_by_b(pieces))
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, n)
        whole = self.spell_a.spell(a, of_a, raw, sizes) & self.spell_b.spell(b, of_b, raw, sizes)
        a, of_a, b, of_b = a[whole[of_a]], of_a[whole[of_a]], b[whole[of_b]], of_b[whole[of_b]]

        # both spell the same bytes, so common ends along all pieces are the groups' ends
        end_a, end_b = np.cumsum(self.spell_a.sizes[a]), np.cumsum(self.spell_b.sizes[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_a, n_b = np.bincount(in_a, minlength=len(cuts)), np.bincount(in_b, minlength=len(cuts))
        piece = of_a[np.cumsum(n_a) - 1]
        figures = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(piece, minlength=n),
                            np.zeros(n, np.int64)], axis=1)
        np.add.at(figures[:, 3], piece, n_a * n_b)

        last_a, last_b = np.diff(in_a, append=-1) != 0, np.diff(in_b, append=-1) != 0
        shown = np.concatenate([a + last_a * len(self.a_bytes), 2 * len(self.a_bytes) + b + last_b * self.b_size])
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        signs = list(map(self.names.__getitem__, shown[order].tolist()))
        bounds = np.cumsum(np.r_[0, figures[:, 0] + figures[:, 1]]).tolist()
        self.groups.extend("".join(signs[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:]))

        codes, owners, weights = self._linked(a, b, n_a, n_b, piece)
        base = len(self.a_bytes) * self.b_size
        key = owners * base + codes
        if len(key):
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, weights = key[new], np.add.reduceat(weights[order], new)
        self.pairs, self.times = np.concatenate([self.pairs, key % base]), np.concatenate([self.times, weights])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(key // base, minlength=n))])
        self.whole, self.figures = np.concatenate([self.whole, whole]), np.concatenate([self.figures, figures])

    def _linked(self, a, b, n_a, n_b, piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs of all groups, the piece of each, and how often; ids of a large group are tallied first."""
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        small = np.flatnonzero(n_a * n_b <= 256)
        left = _ranges(start_a[small], n_a[small])
        group = np.repeat(small, n_a[small])
        right = _ranges(start_b[group], n_b[group])
        codes = [np.repeat(a[left], n_b[group]) * self.b_size + b[right]]
        owners, weights = [np.repeat(piece[group], n_b[group])], [np.ones(len(right), np.int64)]
        for g in np.flatnonzero(n_a * n_b > 256).tolist():
            x, times_x = np.unique(a[start_a[g]: start_a[g] + n_a[g]], return_counts=True)
            y, times_y = np.unique(b[start_b[g]: start_b[g] + n_b[g]], return_counts=True)
            codes.append(np.add.outer(x * self.b_size, y).ravel())
            weights.append(np.multiply.outer(times_x, times_y).ravel())
            owners.append(np.full(len(codes[-1]), piece[g]))
        return np.concatenate(codes), np.concatenate(owners), np.concatenate(weights)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's pieces, in order."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        new = dict.fromkeys(p for pieces in cut for p in pieces if p not in self.known)
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)) for pieces in cut]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of about SLICE bytes; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
        first = 0
        for row, n in enumerate(lengths):
            if size and size + n > SLICE:
                ids.append(batch.column(0).slice(first, row - first))
                texts.extend(batch.column(1).slice(first, row - first).to_pylist())
                yield pa.concat_arrays(ids), texts
                ids, texts, size, first = [], [], 0, row
            size += n
        ids.append(batch.column(0).slice(first))
        texts.extend(batch.column(1).slice(first).to_pylist())
    if texts:
        yield pa.concat_arrays(ids), texts


def _blocks(run: str, tok: Tokenizers, numbers: list[np.ndarray]) -> Iterator[tuple]:
    """The (pair, document) records of a run, ordered and packed by radix of the A id."""
    n_docs, n_known = len(numbers), len(tok.groups)
    held = np.repeat(np.arange(n_docs), [len(x) for x in numbers])
    keys, times = np.unique(held * n_known + np.concatenate(numbers), return_counts=True)
    doc, piece = keys // n_known, keys % n_known
    size = np.diff(tok.ends)[piece]
    if not size.sum():
        return
    at = _ranges(tok.ends[piece], size)
    code, weight = tok.pairs[at], tok.times[at] * np.repeat(times, size)
    doc = np.repeat(doc, size)
    a = code // tok.b_size
    place = (a % RADICES) * ((a.max() // RADICES + 1) * tok.b_size)
    key = (place + (a // RADICES) * tok.b_size + code % tok.b_size) * n_docs + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # one record for each pair and document
    weight, code, doc = np.add.reduceat(weight[order], new), code[order[new]], doc[order[new]]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])  # one for each pair
    pairs, docs_of = code[first], np.diff(np.r_[first, len(code)])
    radix = pairs // tok.b_size % RADICES
    cuts = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1], True])
    at_record = np.r_[first, len(code)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        mine = slice(at_record[lo], at_record[hi])
        steps = np.diff(pairs[lo:hi], prepend=0)
        yield (run, int(radix[lo]), pack(steps), pack(docs_of[lo:hi]), pack(np.r_[doc[mine], weight[mine]]))


def _runs(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value  # a worker serves many tasks and keeps this dict, and so what is put into it
        if "tokenizers" not in kept:
            kept["tokenizers"] = Tokenizers(kept["a"], kept["b"])
        tok: Tokenizers = kept["tokenizers"]
        for ids, texts in _texts(batches):
            if len(tok.groups) > REMEMBERED or tok.held > 8 * SLICE:
                tok.forget()
            run, numbers = uuid.uuid4().hex, tok.numbers(texts)
            numbers = [x if tok.whole[x].all() else x[:0] for x in numbers]
            sums = np.array([tok.figures[x].sum(axis=0) for x in numbers])
            digests = [hashlib.sha256("".join(map(tok.groups.__getitem__, x.tolist()))[:-1].encode()).hexdigest() if len(x)
                       else "" for x in numbers]
            head = pa.RecordBatch.from_arrays([ids, *map(pa.array, sums.T), pa.array(digests)], ["doc_id", *FIGURES, "groups_sha256"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(head)
            yield _table([(run, -1, None, None, sink.getvalue().to_pybytes())])
            rows = []
            for row in _blocks(run, tok, numbers):
                rows.append(row)
                if len(rows) == 64:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)
    return encode


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["run", "radix", "pairs", "counts", "postings"])


def runs_of(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """The packed runs of docs (doc_id, text), written once, and the size of B's vocabulary.

    Both tokenizer files are read by the driver and sent once to each executor.
    """
    import sentencepiece

    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = {"a": a.read(), "b": b.read()}
    b_size = sentencepiece.SentencePieceProcessor(model_proto=files["b"]).get_piece_size()
    shared = docs.sparkSession.sparkContext.broadcast(files)
    return materialized(docs.select("doc_id", "text").mapInArrow(_runs(shared), RUN_SCHEMA), "runs"), b_size


def merged(blocks: list[tuple[str, bytes, bytes]], b_size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Merge blocks (run, pairs, counts) of one radix by a heap of cursors, one A id at a time.

    Yields the A id, its distinct pairs, their counts, and (block, places of its pairs among them) for each block that
    holds the A id.
    """
    cursors, heap = [], []
    for k, (_, pairs, counts) in enumerate(blocks):
        code = np.cumsum(unpack(pairs))
        a = code // b_size
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
        cursors.append((code, unpack(counts), a[cuts[:-1]].tolist(), cuts.tolist()))
        heap.append((cursors[k][2][0], k, 0))
    heapq.heapify(heap)
    while heap:
        least, codes, numbers, members = heap[0][0], [], [], []
        while heap and heap[0][0] == least:
            _, k, step = heap[0]
            code, count, ids, cuts = cursors[k]
            codes.append(code[cuts[step]: cuts[step + 1]])
            numbers.append(count[cuts[step]: cuts[step + 1]])
            members.append(k)
            if step + 1 < len(ids):
                heapq.heapreplace(heap, (ids[step + 1], k, step + 1))
            else:
                heapq.heappop(heap)
        pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.concatenate(numbers))
        bounds = np.cumsum([0, *map(len, codes)])
        yield least, pairs, total, [(k, place[lo:hi]) for k, lo, hi in zip(members, bounds[:-1], bounds[1:])]


def _radices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes, bytes]]]]:
    """The blocks of each radix; rows come ordered by radix."""
    now, blocks = None, []
    for batch in batches:
        for radix, *block in zip(*(batch.column(i).to_pylist() for i in (1, 0, 2, 3))):
            if radix != now and blocks:
                yield now, blocks
                blocks = []
            now = radix
            blocks.append(tuple(block))
    if blocks:
        yield now, blocks


def _replies(b_size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for radix, blocks in _radices(batches):
            back: list[list[np.ndarray]] = [[] for _ in blocks]
            for _, _, total, members in merged(blocks, b_size):
                told = total * 2 + (total == total.max())
                for k, place in members:
                    back[k].append(told[place])
            for lo in range(0, len(blocks), 64):
                some = range(lo, min(lo + 64, len(blocks)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([blocks[k][0] for k in some], pa.string()), pa.array([radix] * len(some), pa.int32()),
                     pa.array([pack(np.concatenate(back[k])) for k in some], pa.binary())], ["run", "radix", "told"])
    return count


def _pairs(b_size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _radices(batches):
            for a, pairs, total, _ in merged(blocks, b_size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), a), pa.int64()), pa.array(pairs % b_size, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(total == total.max(), pa.bool_())],
                    ["a_id", "b_id", "documents", "best"])
    return count


def _by_radix(runs: DataFrame) -> DataFrame:
    return (runs.where("radix >= 0").select("run", "radix", "pairs", "counts")
            .repartition("radix").sortWithinPartitions("radix", "run"))


def _documents(own: pa.Table, replies: pa.Table) -> pa.Table:
    """Add what the replies say up to the documents of one run."""
    told = dict(zip(replies.column("radix").to_pylist(), replies.column("told").to_pylist()))
    head, blocks = None, []
    for radix, counts, postings in zip(*(own.column(c).to_pylist() for c in ("radix", "counts", "postings"))):
        if radix < 0:
            head = pa.ipc.open_stream(postings).read_all()
        else:
            blocks.append((radix, counts, postings))
    best, sums = np.zeros(head.num_rows, np.int64), np.zeros(head.num_rows, np.int64)
    for radix, counts, postings in blocks:
        doc, weight = np.split(unpack(postings), 2)
        mine = np.repeat(unpack(told[radix]), unpack(counts))
        np.add.at(best, doc, weight * (mine & 1))
        np.add.at(sums, doc, weight * (mine >> 1))
    columns = {c: head.column(c) for c in head.column_names}
    return pa.table({**{c: columns[c] for c in ("doc_id", *FIGURES)}, "n_best": best, "count_sum": sums,
                     "groups_sha256": columns["groups_sha256"]})


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    runs, b_size = runs_of(docs, a_path, b_path)
    replies = _by_radix(runs).mapInArrow(_replies(b_size), "run string, radix int, told binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{c} bigint" for c in (*FIGURES, "n_best", "count_sum"))
    return (runs.select("run", "radix", "counts", "postings").groupBy("run").cogroup(replies.groupBy("run"))
            .applyInArrow(_documents, f"doc_id {kind}, {fields}, groups_sha256 string"))


def alignment_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every linked pair of ids: a_id, b_id, documents that hold it, and whether no pair of the A id has more."""
    runs, b_size = runs_of(docs, a_path, b_path)
    return _by_radix(runs).mapInArrow(_pairs(b_size), "a_id bigint, b_id bigint, documents bigint, best boolean")
