"""Bytes of many texts at once: word bounds, word hashes and word shingles in numpy.

Everything works on the data buffer of an Arrow string column, so no Python string is made per word. Hashes are
64-bit; a polynomial over the bytes gives a word's hash from two prefix sums, whatever the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = U64(0xD6E8FEB86659FD93)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


RAW_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_VALUES = RAW_VALUES[_LOWER]
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2^64; kept for the longest n so far."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, U64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def slices(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``most_bytes``; a longer row stands alone.

    Null texts have no bytes.
    """
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, kind)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1)
        yield first, end, raw[at[first]: at[end]], at[first: end + 1] - at[first]
        first = end


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes, given a 64-bit value for each byte."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, in order, and the word bounds of each text (len(at) values)."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = at[:-1][at[:-1] < n]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return range_hashes(BYTE_VALUES[data], begin, end), np.searchsorted(begin, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, concatenated, and their bounds.

    A text of fewer than k words, but not none, has its whole word sequence as its one shingle.
    """
    words, of = word_hashes(data, at)
    texts, total = len(at) - 1, len(words)
    counts = np.diff(of)
    rolled = words.copy()
    for j in range(1, k):
        rolled[: total - j] = rolled[: total - j] * _FOLD + words[j:] if total > j else rolled[: total - j]
    rolled = mixed(rolled)
    parts, sizes = [], np.zeros(texts, np.int64)
    for t in range(texts):
        c, a = counts[t], of[t]
        if c >= k:
            parts.append(np.unique(rolled[a: a + c - k + 1]))
            sizes[t] = len(parts[-1])
        elif c:
            value = int(c)
            for w in words[a: a + c].tolist():
                value = (value * int(_FOLD) + w) & 0xFFFFFFFFFFFFFFFF
            parts.append(mixed(np.array([value ^ 0xA5A5A5A5], U64)))
            sizes[t] = 1
    bounds = np.zeros(texts + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), bounds
