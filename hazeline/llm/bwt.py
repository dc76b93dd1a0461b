"""Repeated strings by merging the Burrows-Wheeler transforms of shards of texts.

Each shard is sorted on its own. The transforms are then merged by refining an interleave: a pass deals the current
order out by the character before each suffix, stably, and so sorts one character deeper; where the character or the
class of the suffix after it changes, a new class of suffixes with a common prefix of that length begins. Two
characters are dealt at once where their pairs fit into 16 bits. When ``depth`` characters are done, the classes with
two members or more are the repeated strings of that length. No suffixes are compared or sorted again.
"""

from __future__ import annotations

import numpy as np

END = 0  # sorts before all bytes, which are moved up by one


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of a shard's suffixes by the first ``depth`` symbols or more, ties by place; strings are closed by END."""
    n = len(text)
    rank = text.astype(np.int64)
    ends = text == END
    rank[~ends] += n  # every end is a symbol of its own
    rank[ends] = np.arange(int(ends.sum()))
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1 if n > length else after[:0]
        order = np.argsort(rank * (2 * n + 512) + after, kind="stable")
        if length * 2 >= 2 * depth:
            break
        key = rank[order], after[order]
        new = np.ones(n, bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        length *= 2
        if new.all():
            break
    return order


def before(text: np.ndarray, order: np.ndarray, step: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``step`` symbols before each suffix as one number, and whether one of them is END."""
    one = np.roll(text, 1)
    if step == 1:
        return one[order], (one == END)[order]
    two = np.roll(text, 2)
    ends = (one == END) | (two == END)
    return (two * np.uint16(symbols) + one)[order], ends[order]


def merged_classes(shards: list[tuple[np.ndarray, np.ndarray]], depth: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and place of every suffix in the merged order, and the class of its first ``depth`` symbols.

    shards: symbols below ``symbols`` and suffix orders. Suffixes that reach an end within ``depth`` stand alone.
    """
    step = 2 if depth % 2 == 0 and symbols ** 2 <= 1 << 16 else 1
    if len(shards) > 1 << 16:
        raise ValueError("too many shards")
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(order) for _, order in shards])
    streams = [before(text, order, step, symbols) for text, order in shards]
    stream, closed = (np.concatenate([s[i] for s in streams]) for i in (0, 1))
    total = len(source)
    first = np.zeros(total, bool)
    first[:1] = True
    merged, ends = np.empty(total, np.uint16), np.empty(total, bool)
    for _ in range(depth // step):
        turn = np.argsort(source, kind="stable") if len(shards) > 1 else slice(None)
        merged[turn], ends[turn] = stream, closed
        deal = np.argsort(merged, kind="stable")
        dealt, block = merged[deal], np.cumsum(first, dtype=np.int32)[deal]
        source = source[deal]
        first = ends[deal]
        first[1:] |= (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])
        first[:1] = True
    place = np.empty(total, np.int64)
    for k, (_, order) in enumerate(shards):
        place[source == k] = order
    return source, place, np.cumsum(first) - 1


def repeated_starts(strings: list[bytes], depth: int, shard_bytes: int = 1 << 18, owner: np.ndarray | None = None) -> list[np.ndarray]:
    """For each string a flag for every start: its ``depth`` bytes also start at another place of these strings.

    With ``owner``, a number for each string, only strings of the same owner are compared.
    """
    texts: list[list[bytes]] = [[]]
    size = 0
    for s in strings:
        if size > shard_bytes:
            texts.append([])
            size = 0
        texts[-1].append(s)
        size += len(s) + 1
    used = np.flatnonzero(np.bincount(np.frombuffer(b"".join(strings), np.uint8), minlength=256))
    code = np.zeros(256, np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    shards, bounds = [], []
    for mine in texts:
        lengths = np.array([len(s) for s in mine], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(lengths.sum()) + len(mine), np.uint16)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = code[np.frombuffer(b"".join(mine), np.uint8)]
        shards.append((text, shard_order(text, depth)))
        bounds.append((ends - lengths, lengths))
    source, place, kind = merged_classes(shards, depth, len(used) + 1)
    if owner is None:
        owner = np.zeros(len(strings), np.int64)
    keys, at, done = [], [], 0
    for k, (starts, lengths) in enumerate(bounds):
        classes = np.empty(len(shards[k][0]), np.int64)
        classes[place[source == k]] = kind[source == k]
        sizes = np.maximum(lengths - depth + 1, 0)
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys.append(classes[np.repeat(starts, sizes) + offset] * (int(owner.max(initial=0)) + 1)
                    + np.repeat(owner[done: done + len(lengths)], sizes))
        at += sizes.tolist()
        done += len(lengths)
    _, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return np.split(times[which] > 1, np.cumsum(at)[:-1])
