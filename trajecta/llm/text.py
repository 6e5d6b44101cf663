"""Vectorised helpers shared by the text operators: Arrow slices, words, and hashes in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. Hashes are polynomials modulo the prime 2**61 - 1 at fixed points that
were drawn at random: two different strings of at most n symbols, chosen without regard to the point, have equal hashes with a chance
of at most n / 2**61. (Modulo 2**64 there are strings that collide at every point.) A mixing step, which maps no two values to one, spreads their bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PRIME = U((1 << 61) - 1)
_POINT = 0x11C5A6F0D3B94E27
_SYMBOL_POINT = 0x0A7D3F8C6B1E5942
_BLOCK = 1 << 15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of a uint64 over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> U(61))
    np.subtract(x, PRIME, out=x, where=x >= PRIME)
    return x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of residues, by halves of 31 and 30 bits, a cache-sized block at a time."""
    out = np.empty(len(a), U)
    for i in range(0, len(a), _BLOCK):
        x, y = a[i : i + _BLOCK], b[i : i + _BLOCK]
        xh, yh, xl, yl = x >> U(31), y >> U(31), x & U(0x7FFFFFFF), y & U(0x7FFFFFFF)
        mid = xl * yh + xh * yl
        out[i : i + _BLOCK] = _reduced((xh * yh << U(1)) + (mid >> U(30)) + ((mid & U(0x3FFFFFFF)) << U(31)) + xl * yl)
    return out


def _powers(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """point**i and point**-i modulo 2**61 - 1 for i up to n."""
    have = _tables.get(point)
    if have is None or len(have[0]) <= n:
        size = max(1 << n.bit_length(), 1 << 16)
        out = []
        for b in (point, pow(point, -1, int(PRIME))):
            a = np.ones(size, U)
            done = 1
            while done < size:
                more = min(done, size - done)
                a[done : done + more] = product(a[:more], np.full(more, pow(b, done, int(PRIME)), U))
                done += more
            out.append(a)
        have = out[0], out[1]
        if size <= 4 * SLICE_BYTES:
            _tables[point] = have
    return have


class Rolling:
    """Hashes of any ranges of one symbol sequence, by prefix sums. Symbols are below 2**61 - 2 or are taken modulo 2**61 - 1."""

    def __init__(self, symbols: np.ndarray, point: int = _POINT):
        power, self.inverse = _powers(point, len(symbols))
        terms = product(_reduced(symbols.astype(U)) + U(1), power[: len(symbols)])
        high, low = np.cumsum(terms >> U(31)), np.cumsum(terms & U(0x7FFFFFFF))
        self.prefix = np.zeros(len(symbols) + 1, U)
        self.prefix[1:] = _reduced((high >> U(30)) + ((high & U(0x3FFFFFFF)) << U(31)) + low)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(product(_reduced(self.prefix[end] + (PRIME - self.prefix[start])), self.inverse[start]))


def symbols(values: np.ndarray) -> Rolling:
    """Rolling hashes over 64-bit symbols, such as word hashes."""
    return Rolling(values, _SYMBOL_POINT)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches cut so that each has at most `limit` bytes of the column, or one row; with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = buffers(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
    release()


def release() -> None:
    """Give power tables and freed memory back to the system, so that a Python worker that waits for its next task holds little."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of the words before it (n + 1 entries)."""
    solid = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at, "left")


def text_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null is the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
