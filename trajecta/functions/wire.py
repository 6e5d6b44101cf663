"""Binary messages: MessagePack maps in which arrays are maps of data, dtype and shape.

Written from the public format specification, for the types that such messages hold. Object, void and complex arrays are errors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ARRAY, SCALAR = b"__ndarray__", b"__npgeneric__"
_BLOCK = 1 << 20


def _sized(n: int, small: tuple[int, int] | None, heads: tuple[int | None, int, int]) -> bytes:
    if small and n < small[1]:
        return bytes([small[0] | n])
    for head, kind, limit in zip(heads, ("B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32)):
        if head is not None and n < limit:
            return bytes([head]) + struct.pack(kind, n)
    raise ValueError("too long")


def pack(x: object) -> bytes:
    if isinstance(x, (np.ndarray, np.generic)):
        if x.dtype.kind in "VOc":
            raise ValueError(f"dtype {x.dtype} is not supported")
        if isinstance(x, np.ndarray):
            return pack({ARRAY: True, b"data": x.tobytes(), b"dtype": x.dtype.str, b"shape": list(x.shape)})
        return pack({SCALAR: True, b"data": x.item(), b"dtype": x.dtype.str})
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if -32 <= x < 128:
            return struct.pack("b", x)
        for head, kind, low, high in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)):
            if low <= x < high:
                return bytes([head]) + struct.pack(kind, x)
        raise ValueError("integer out of range")
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return _sized(len(data), (0xA0, 32), (0xD9, 0xDA, 0xDB)) + data
    if isinstance(x, (bytes, bytearray)):
        return _sized(len(x), None, (0xC4, 0xC5, 0xC6)) + bytes(x)
    if isinstance(x, (list, tuple)):
        return _sized(len(x), (0x90, 16), (None, 0xDC, 0xDD)) + b"".join(map(pack, x))
    if isinstance(x, dict):
        return _sized(len(x), (0x80, 16), (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(v) for k, v in x.items())
    raise ValueError(f"{type(x).__name__} is not supported")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def value(self) -> object:
        head = self.number("B")
        if head < 0x80:
            return head
        if head >= 0xE0:
            return head - 256
        if head < 0x90:
            return self.map(head & 15)
        if head < 0xA0:
            return [self.value() for _ in range(head & 15)]
        if head < 0xC0:
            return self.take(head & 31).decode()
        if head in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[head]
        numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
        if head in numbers:
            return self.number(numbers[head])
        sizes = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
        n = self.number(sizes[head])
        if head <= 0xC6:
            return self.take(n)
        if head <= 0xDB:
            return self.take(n).decode()
        return [self.value() for _ in range(n)] if head <= 0xDD else self.map(n)

    def map(self, n: int) -> object:
        out = {}
        for _ in range(n):
            key = self.value()
            out[key] = self.value()
        if ARRAY in out:
            return np.frombuffer(out[b"data"], np.dtype(out[b"dtype"])).reshape(out[b"shape"])
        if SCALAR in out:
            return np.dtype(out[b"dtype"]).type(out[b"data"])
        return out


def unpack(data: bytes) -> object:
    return _Reader(data).value()


def _frame(n: int) -> tuple[bytes, bytes]:
    """What stands before and after the numbers in the message of n doubles."""
    end = pack(b"dtype") + pack("<f8") + pack(b"shape") + pack([n])
    return pack(np.zeros(n, "<f8"))[: -8 * n - len(end)], end


def _bounds(x: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a list or binary array; nulls are empty."""
    sizes = pc.list_value_length(x) if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else pc.binary_length(x)
    return np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _by_size(size: np.ndarray, valid: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each size and the valid rows that have it, at most _BLOCK bytes or numbers at once."""
    for n in np.unique(size[valid]).tolist():
        rows = np.flatnonzero(valid & (size == n))
        step = max(1, _BLOCK // max(1, n))
        for i in range(0, len(rows), step):
            yield n, rows[i : i + step]


def packed(x: pa.Array) -> pa.Array:
    """A message for each vector of a list array, those of one length at once; null elements are NaN."""
    valid = x.is_valid().to_numpy(zero_copy_only=False)
    values = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype("<f8", copy=False)
    at = _bounds(x)
    size = np.diff(at)
    out: list[bytes | None] = [None] * len(x)
    for n, rows in _by_size(size, valid):
        head, end = _frame(n)
        block = np.empty((len(rows), len(head) + 8 * n + len(end)), np.uint8)
        block[:, : len(head)] = np.frombuffer(head, np.uint8)
        block[:, len(head) : len(head) + 8 * n] = np.ascontiguousarray(values[at[rows][:, None] + np.arange(n)]).view(np.uint8)
        block[:, len(head) + 8 * n :] = np.frombuffer(end, np.uint8)
        data, width = block.tobytes(), block.shape[1]
        for i, row in enumerate(rows.tolist()):
            out[row] = data[i * width : (i + 1) * width]
    return pa.array(out, pa.binary())


def unpacked(x: pa.Array) -> pa.Array:
    """The numbers of each message of a binary array: messages of doubles that are framed as `pack` does it at once, all others read one by one."""
    valid = x.is_valid().to_numpy(zero_copy_only=False)
    at = _bounds(x)
    size = np.diff(at)
    raw = np.frombuffer(b"".join(x.drop_null().to_pylist()), np.uint8)
    least = sum(map(len, _frame(0)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(x), np.int64)
    for width, rows in _by_size(size, valid):
        # Longer vectors have up to 7 bytes more around their numbers than the empty one.
        n = (width - least) // 8
        block = raw[at[rows][:, None] + np.arange(width)]
        fits = np.zeros(len(rows), bool)
        if n >= 0 and sum(map(len, frame := _frame(n))) + 8 * n == width:
            head, end = (np.frombuffer(b, np.uint8) for b in frame)
            fits = (block[:, : len(head)] == head).all(axis=1) & (block[:, len(head) + 8 * n :] == end).all(axis=1)
            counts[rows[fits]] = n
            found.append((rows[fits], np.ascontiguousarray(block[fits, len(head) : len(head) + 8 * n]).view("<f8")))
        for row, message in zip(rows[~fits].tolist(), block[~fits]):
            numbers = [float(v) for v in np.ravel(unpack(message.tobytes()))]
            counts[row] = len(numbers)
            found.append((np.array([row]), np.array([numbers], np.float64)))
    place = np.concatenate([[0], np.cumsum(counts)])
    values = np.empty(place[-1], np.float64)
    for rows, numbers in found:
        values[place[rows][:, None] + np.arange(numbers.shape[1])] = numbers
    return pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(values), mask=pa.array(~valid))


def pack_vector(x: Column) -> Column:
    """A vector column as messages."""
    return F.arrow_udf(packed, "binary")(x)


def unpack_vector(x: Column) -> Column:
    return F.arrow_udf(unpacked, "array<double>")(x)
