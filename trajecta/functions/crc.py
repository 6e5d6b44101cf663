"""CRC-32C (Castagnoli) of many byte strings at once, in numpy, and the masked form that record files store."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
LANE = 1024


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


TABLE = _table()
_LIST = TABLE.tolist()


def _advanced(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """States after the bytes of each row; columns[i] are the i-th bytes."""
    for column in columns:
        state = TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


@cache
def _shift() -> np.ndarray:
    """What LANE zero bytes make of each byte of a state: 4 tables of 256."""
    states = (np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    return _advanced(states, np.zeros((LANE, 1), np.uint32)).reshape(4, 256)


def crc32c(data: bytes) -> int:
    state = 0xFFFFFFFF
    for b in data:
        state = _LIST[(state ^ b) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def crc32c_many(parts: Sequence[bytes]) -> np.ndarray:
    """Of each part. Long parts are cut into lanes that advance together; a state is linear in the bytes, so lanes are put together by shifts."""
    out = np.zeros(len(parts), np.uint32)
    large = [i for i, p in enumerate(parts) if len(p) >= 64]
    if sum(len(parts[i]) for i in large) < 16 * LANE:
        large = []
    chosen = set(large)
    for i, p in enumerate(parts):
        if i not in chosen:
            out[i] = crc32c(p)
    if not large:
        return out
    lanes = np.array([-(-len(parts[i]) // LANE) for i in large])
    first = np.append(0, np.cumsum(lanes))
    padded = np.zeros(first[-1] * LANE, np.uint8)
    for n, i in enumerate(large):
        # Zeros before the first byte leave the empty state as it is; the initial state is the first four bytes turned over.
        begin = first[n + 1] * LANE - len(parts[i])
        padded[begin : first[n + 1] * LANE] = np.frombuffer(parts[i], np.uint8)
        padded[begin : begin + 4] ^= 255
    state = _advanced(np.zeros(first[-1], np.uint32), padded.reshape(-1, LANE).T.astype(np.uint32))
    total, shift = np.zeros(len(large), np.uint32), _shift()
    for k in range(int(lanes.max())):
        live = np.flatnonzero(lanes > k)
        before = total[live]
        total[live] = shift[0, before & 255] ^ shift[1, (before >> 8) & 255] ^ shift[2, (before >> 16) & 255] ^ shift[3, before >> 24] ^ state[first[live] + k]
    out[large] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    x = np.asarray(crc, np.uint64)
    return ((((x >> np.uint64(15)) | (x << np.uint64(17))) + np.uint64(MASK)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def masked_windows(data: np.ndarray, size: int = 8) -> np.ndarray:
    """The masked sum of every window of `size` bytes."""
    n = max(0, len(data) - size + 1)
    columns = (data[k : k + n].astype(np.uint32) for k in range(size))
    return masked(_advanced(np.full(n, 0xFFFFFFFF, np.uint32), columns) ^ np.uint32(0xFFFFFFFF))
