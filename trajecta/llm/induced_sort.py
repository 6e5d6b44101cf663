"""External induced suffix sorting with common-prefix values.

As in the external variant of induced sorting: the suffixes that begin a rising run (S*) are sorted first, by naming the
substrings between them and sorting the string of names, recursively while names repeat and they do not fit in memory.
From these, one ascending pass induces the order of the falling (L) suffixes and one descending pass that of the rising (S) ones.
Each pass takes tuples (suffix, common prefix with the one before) from a priority queue whose keys are first symbols; a queue
beyond `memory` tuples writes its buckets to files, and the text of a large shard is a memory map. The tuples of one key
leave the queue in blocks, so that numpy handles a block at a time. Common-prefix values are capped at `cap`.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

PAD = 511
MANY = np.iinfo(np.int32).max
TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])


class BucketQueue:
    """Priority queue of tuples with small integer keys, first in first out within a key; spills to files beyond `memory` tuples."""

    def __init__(self, keys: int, memory: int, folder: str):
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(keys)]
        self.written: set[int] = set()
        self.memory, self.folder, self.held = memory, folder, 0

    def _file(self, key: int) -> str:
        return os.path.join(self.folder, f"{id(self)}-{key}")

    def push(self, key: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[key].append((at, lcp))
        self.held += len(at)
        if self.held > self.memory:
            for k, blocks in enumerate(self.parts):
                if blocks:
                    with open(self._file(k), "ab") as f:
                        for a, b in blocks:
                            block = np.empty(len(a), TUPLE)
                            block["at"], block["lcp"] = a, b
                            block.tofile(f)
                    self.parts[k] = []
                    self.written.add(k)
            self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a key, in the order in which they came."""
        blocks, self.parts[key] = self.parts[key], []
        self.held -= sum(len(a) for a, _ in blocks)
        if key in self.written:
            self.written.remove(key)
            block = np.fromfile(self._file(key), TUPLE)
            os.remove(self._file(key))
            blocks = [(block["at"], block["lcp"]), *blocks]
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([a for a, _ in blocks]), np.concatenate([b for _, b in blocks])


def rising(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last symbol is the only smallest and counts as rising."""
    up = np.ones(len(text), bool)
    up[:-1] = text[1:] > text[:-1]
    ends = np.ones(len(text), bool)
    ends[:-1] = text[1:] != text[:-1]
    places = np.flatnonzero(ends)
    return np.repeat(up[places], np.diff(places, prepend=-1))


def sevens(text: np.ndarray) -> np.ndarray | None:
    """From each place on seven symbols of nine bits in one number, 0 for those past the end; None if a symbol is PAD or greater."""
    if int(text.max()) >= PAD:
        return None
    out = text.astype(np.int64) << 54
    for d in range(1, 7):
        out[:-d] |= text[d:].astype(np.int64) << 9 * (6 - d)
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, packed: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, at most `cap`. packed: `sevens` of a text that ends in its only 0, whose
    different suffixes differ before either ends."""
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    if packed is not None:
        for d in range(0, cap, 7):
            apart = packed[a[live] + d] ^ packed[b[live] + d]
            ended = apart != 0
            rest = apart[ended]
            out[live[ended]] = np.minimum(d + sum((rest < 1 << 9 * k).astype(np.int32) for k in range(1, 7)), cap)
            live = live[~ended]
            if not len(live):
                return out
        out[live] = cap
        return out
    for d in range(cap):
        x, y = a[live] + d, b[live] + d
        inside = np.maximum(x, y) < len(text)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] = d + 1
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string that fits in memory, by prefix doubling."""
    rank = names.astype(np.int64)
    n, k = len(rank), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def _named(text: np.ndarray, stars: np.ndarray, packed: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Rank of each substring from one S* suffix through the next, equal ones alike. A substring that ends inside another
    one is the greater, as the other falls there; so ends are padded with the greatest symbol."""
    end = np.append(stars[1:], len(text) - 1)
    take = 1 if packed is None else 7
    pad = int(text.max()) + 1
    rank = np.zeros(len(stars), np.int64)
    live, offset = np.arange(len(stars)), 0
    while len(live):
        place = stars[live] + offset
        if packed is None:
            key = np.where(place <= end[live], text[np.minimum(place, len(text) - 1)], pad)
        else:
            bits = 9 * (7 - np.clip(end[live] - place + 1, 0, 7))
            key = packed[np.minimum(place, len(text) - 1)] >> bits << bits | (1 << bits) - 1
        order = np.lexsort((key, rank[live])) if offset else np.argsort(key)
        r, k = rank[live][order], key[order]
        first = np.ones(len(order), bool)
        first[1:] = r[1:] != r[:-1]
        new = first.copy()
        new[1:] |= k[1:] != k[:-1]
        # A group keeps the rank it has, and its parts come after it by their places; ranks have gaps until the end.
        begin = np.flatnonzero(first)
        group = np.repeat(begin, np.diff(np.append(begin, len(order))))
        part = np.flatnonzero(new)
        at = np.repeat(part, np.diff(np.append(part, len(order))))
        rank[live[order]] = r + at - group
        size = np.repeat(np.diff(np.append(part, len(order))), np.diff(np.append(part, len(order))))
        offset += take
        going = live[order][size > 1]
        live = np.sort(going[stars[going] + offset <= end[going] + 1])  # one that has just ended still gets its padding
    values, dense = np.unique(rank, return_inverse=True)
    return dense, len(values)


def _induce(text: np.ndarray, source: np.ndarray, lcp: np.ndarray, wanted: np.ndarray, queue: BucketQueue, last: np.ndarray, cap: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Push the suffixes before those of a block of sources that are `wanted`, each with its common prefix with the suffix pushed
    before it to its key. last: by key the least common prefix of sources since that push, -1 before the first.
    Returned and not pushed: those of the key `own`, which is being read."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int32)
    if not len(source):
        return empty
    pick = np.flatnonzero((source > 0) & wanted[source - 1])
    low = int(lcp.min())
    back = empty
    if len(pick):
        before = source[pick] - 1
        key = text[before]  # numpy sorts symbols of two bytes by radix
        order = np.argsort(key, kind="stable")
        pick, before, key = pick[order], before[order], key[order].astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        start = np.empty(len(pick), np.int64)
        start[1:] = pick[:-1] + 1
        start[begin] = 0
        padded = np.append(lcp, MANY)
        pairs = np.empty(2 * len(pick), np.int64)
        pairs[::2], pairs[1::2] = start, pick + 1
        least = np.minimum.reduceat(padded, pairs)[::2]
        keys = key[begin]
        known = last[keys]
        value = np.minimum(least + 1, cap)
        value[begin] = np.where(known < 0, 0, np.minimum(np.minimum(least[begin], known) + 1, cap))
        stop = np.append(begin[1:], len(pick))
        final = pick[stop - 1] + 1
        pairs = np.empty(2 * len(final), np.int64)
        pairs[::2], pairs[1::2] = final, len(lcp)
        rest = np.where(final < len(lcp), np.minimum.reduceat(padded, pairs)[::2], MANY)
        for k, a, b in zip(keys.tolist(), begin.tolist(), stop.tolist()):
            if k == own:
                back = before[a:b], value[a:b]
            else:
                queue.push(k, before[a:b], value[a:b])
        last[last >= 0] = np.minimum(last[last >= 0], low)
        last[keys] = rest
    else:
        last[last >= 0] = np.minimum(last[last >= 0], low)
    return back


def suffixes(text: np.ndarray, cap: int, memory: int = 1 << 22, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of `text` in order, by blocks of one first symbol, each with its common prefix (at most `cap`) with the one
    before. The last symbol must be 0 and the only 0."""
    with tempfile.TemporaryDirectory(dir=folder) as scratch:
        yield from _sorted(text, cap, memory, scratch)


def _star_order(text: np.ndarray, stars: np.ndarray, packed: np.ndarray | None, memory: int, folder: str) -> np.ndarray:
    names, distinct = _named(text, stars, packed)
    if distinct == len(stars):
        return np.argsort(names, kind="stable")
    if len(stars) <= memory:
        return doubled(names)
    reduced = np.append(names + 1, 0)
    found = np.concatenate([at for at, _ in _sorted(reduced, 1, memory, folder)])
    return found[found < len(stars)]


def _sorted(text: np.ndarray, cap: int, memory: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(text) * text.itemsize > 8 * memory and not isinstance(text, np.memmap):
        kept = np.memmap(os.path.join(folder, f"text-{len(text)}"), text.dtype, "w+", shape=text.shape)
        kept[:] = text
        text = kept
    n, keys = len(text), int(text.max()) + 1
    up = rising(text)
    star = up.copy()
    star[0] = False
    star[1:] &= ~up[:-1]
    stars = np.flatnonzero(star)
    packed = sevens(text)
    stars = stars[_star_order(text, stars, packed, memory, folder)]
    star_lcp = np.zeros(len(stars), np.int32)
    star_lcp[1:] = common_prefix(text, stars[:-1], stars[1:], cap, packed)
    del packed
    edges = np.searchsorted(text[stars], np.arange(keys + 1))
    used = np.unique(text)

    falls, queue, last = BucketQueue(keys, memory, folder), BucketQueue(keys, memory, folder), np.full(keys, -1, np.int64)
    down = ~up
    for c in used.tolist():
        tail = None
        block = queue.pop(c)
        while len(block[0]):
            falls.push(c, *block)
            tail = block[0][-1:]
            block = _induce(text, *block, down, queue, last, cap, c)
        seeds, lcp = stars[edges[c] : edges[c + 1]], star_lcp[edges[c] : edges[c + 1]].copy()
        if len(seeds):
            lcp[0] = common_prefix(text, tail, seeds[:1], cap)[0] if tail is not None else 0
            _induce(text, seeds, lcp, down, queue, last, cap, -1)

    rises, queue, last = BucketQueue(keys, memory, folder), BucketQueue(keys, memory, folder), np.full(keys, -1, np.int64)
    queue.push(int(text[-1]), np.array([n - 1]), np.array([0], np.int32))
    out = BucketQueue(keys, memory, folder)
    for c in used.tolist()[::-1]:
        tail = None
        block = queue.pop(c)
        while len(block[0]):
            rises.push(c, *block)
            tail = block[0][-1:]
            block = _induce(text, *block, up, queue, last, cap, c)
        at, lcp = falls.pop(c)
        if len(at):
            back = np.append(lcp[1:], 0)[::-1].astype(np.int32)
            back[0] = common_prefix(text, at[-1:], tail, cap)[0] if tail is not None else 0
            _induce(text, at[::-1], back, up, queue, last, cap, -1)
        # Ascending again: the falling suffixes, then the rising ones, whose values are shifted by one.
        high, high_lcp = rises.pop(c)
        joint = common_prefix(text, at[-1:], high[-1:], cap) if len(at) and len(high) else np.zeros(1, np.int32)
        lcp = np.concatenate([lcp, joint, high_lcp[:0:-1]]) if len(high) else lcp
        out.push(c, np.concatenate([at, high[::-1]]), lcp.astype(np.int32))
    for c in used.tolist():
        yield out.pop(c)
