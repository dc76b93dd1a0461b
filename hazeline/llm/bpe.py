"""Byte-level BPE encoding and decoding by rank files (operator 3).

A text is cut into pre-tokens by the tokenizer's pattern. Lookup has two tiers: a minimal perfect hash over the
vocabulary tells whether a whole pre-token is a token, for all new pre-tokens of a block at once; the others are
merged from single bytes with a heap of adjacent pairs over a linked list, so that a pre-token of n bytes takes
n log n steps however long it is. Resolved pre-tokens are remembered up to a bound.

Defined results: a null text is the empty text, which has no tokens; ids are those of the rank file; decoding gives
back the text's bytes. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from hazeline.llm.spans import RAW_VALUES, U64, mixed, range_hashes, slices

REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


class PerfectHash:
    """Minimal perfect hash: a key's number is the rank of the first bit that it alone takes over levels of bits."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        taken, left = 0, keys
        while len(left):
            size = int(len(left) * spread) + 1
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + U64((level + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) % U64(size)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number or -1 for a key that is not of the set."""
        found, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(keys[left], level, len(alone))
            hit = alone[place]
            found[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return found


def _keys(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), U64, len(tokens))


class Vocabulary:
    """Ranks with the perfect hash of their tokens, and the way back from ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        keys = _keys(tokens)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens have the same 64-bit key")
        self.hash = PerfectHash(keys)
        self.slots: list[bytes] = [b""] * len(tokens)
        for token, number in zip(tokens, self.hash.numbers(keys).tolist()):
            self.slots[number] = token
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def whole(self, pieces: list[bytes]) -> list[int | None]:
        """The id of each piece that is a token."""
        numbers = self.hash.numbers(_keys(pieces)).tolist()
        return [self.ranks[p] if n >= 0 and self.slots[n] == p else None for p, n in zip(pieces, numbers)]

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece by merging the adjacent pair of least rank, leftmost first, until none has a rank.

        Parts are a linked list over byte positions; a heap entry is a rank and the position of its left part, and is
        stale unless that part still has this rank with its neighbour.
        """
        n, rank, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        mask = (1 << bits) - 1
        pair = [rank(piece[i: i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            entry = pop(heap)
            i = entry & mask
            if pair[i] != entry >> bits:
                continue
            j = after[i]
            k = after[j]
            after[i], before[k], pair[j] = k, i, -1
            pair[i] = r = rank(piece[i: after[k]], -1) if k < n else -1
            if r >= 0:
                push(heap, r << bits | i)
            if (h := before[i]) >= 0:
                pair[h] = r = rank(piece[h: k], -1)
                if r >= 0:
                    push(heap, r << bits | h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i: after[i]]])
            i = after[i]
        return tuple(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Splitter:
    """Bounds of the pre-tokens of many texts at once, for the one pattern that ``PATTERN_FORM`` shows.

    Pre-tokens are runs of letters, of numbers or of other signs, each with one space before it if there is one; the
    rest of the white space; and the seven English endings where an apostrophe starts a pre-token.
    """

    SPACE, LETTER, NUMBER, OTHER = range(4)

    def __init__(self):
        signs = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        self.kind = np.full(0x110000, self.OTHER, np.uint8)
        for kind, form in ((self.LETTER, r"\p{L}"), (self.NUMBER, r"\p{N}"), (self.SPACE, r"\s")):
            found = "".join(regex.findall(form, signs))
            self.kind[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens start; texts are data[at[i]:at[i + 1]]."""
        place = np.flatnonzero((data & 0xC0) != 0x80)
        signs = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(signs)
        opens = np.zeros(n + 4, bool)
        opens[np.searchsorted(place, at)] = True
        opens[n:] = True
        kind = self.kind[signs]
        start = opens[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == self.SPACE) & (kind[1:] != self.SPACE) & ~opens[1:n])
        start[last] = True
        start[last[signs[last] == 32] + 1] = False
        mark = np.flatnonzero((signs == 39) & start)
        mark = mark[~opens[mark + 1]]
        if len(mark):
            padded = np.concatenate([signs, np.zeros(3, np.uint32)])
            one, two = padded[mark + 1], np.where(opens[mark + 2], 0, padded[mark + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for found, length in ((mark[short], 2), (mark[long], 3)):
                start[found + 1] = False
                end = found + length
                start[end[end < n]] = True
        return place[start]


PATTERN_FORM = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Encodes texts block by block and remembers resolved pre-tokens by their 64-bit hash.

    Every text is decoded again and compared with its bytes; should two pre-tokens ever share a hash, the text that
    shows it is encoded without the memory.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.splitter = Splitter() if vocabulary.pattern == PATTERN_FORM else None
        self.known: dict[int, tuple[int, ...]] = {}

    def split(self, text: bytes) -> list[bytes]:
        return [piece.encode() for piece in regex.findall(self.vocabulary.pattern, text.decode())]

    def resolve(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        return [(token,) if token is not None else self.vocabulary.merged(piece)
                for piece, token in zip(pieces, self.vocabulary.whole(pieces))]

    def _starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.splitter:
            return self.splitter.starts(data, at)
        lengths = []
        for a, b in zip(at[:-1], at[1:]):
            lengths += map(len, self.split(data[a:b].tobytes()))
        return np.cumsum([0, *lengths])[:-1] if lengths else np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[int], bytes]]:
        """Ids and decoded bytes of each text data[at[i]:at[i + 1]]."""
        begin = self._starts(data, at) if len(data) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        keys, first, which = np.unique(range_hashes(RAW_VALUES[data], begin, end), return_index=True, return_inverse=True)
        if len(self.known) > self.remembered:
            self.known = {}
        keys = keys.tolist()
        new = [i for i, key in enumerate(keys) if key not in self.known]
        spans = zip(begin[first[new]].tolist(), end[first[new]].tolist()) if new else ()
        whole = data.tobytes()
        self.known.update(zip((keys[i] for i in new), self.resolve([whole[a:b] for a, b in spans])))
        tokens = [self.known[key] for key in keys]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int64, int(sizes.sum()))
        offset = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(offset[which] - (ends - counts), counts) + np.arange(len(counts) and ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(begin, at)].tolist()
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            mine, text = ids[a:b].tolist(), whole[at[i]: at[i + 1]]
            back = self.vocabulary.decode(mine)
            if back != text:
                mine = list(chain.from_iterable(self.resolve(self.split(text))))
                back = self.vocabulary.decode(mine)
            yield mine, back


def _rows(shared, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value  # a worker serves many tasks and keeps this dict, and so what is put into it
        if "encoder" not in kept:
            kept["names"] = {rank: str(rank) for rank in kept["ranks"].values()}
            kept["encoder"] = Encoder(Vocabulary(kept["ranks"], kept["pattern"]))
        encoder, name = kept["encoder"], kept["names"].__getitem__
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                counts, digests, decoded, lists = [], [], [], []
                for ids, back in encoder.encode(data, at):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        lists.append(ids)
                columns = [batch.column(0).slice(first, end - first), pa.array(counts, pa.int64()),
                           pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)
    return run


def tokenized(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text), with the ids if asked for.

    The rank file is read by the driver and sent once to each executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path), "pattern": pattern})
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_rows(shared, keep_ids), fields)
