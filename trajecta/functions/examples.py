"""Records of named features in the protobuf wire format: a map from a name to a list of bytes, 32-bit floats or 64-bit integers."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import numpy as np

# Field numbers of the message and of the three kinds of list.
KINDS = {1: "bytes", 2: "float", 3: "int"}
NUMBERS = {k: n for n, k in KINDS.items()}
Feature = tuple[str, "list[bytes] | np.ndarray"]


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number does not end")
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """Number, wire type and value of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}.get(kind), at)
            if size is None or at + size > len(data):
                raise ValueError(f"field {number} is cut off or of unknown type {kind}")
            value, at = data[at : at + size], at + size
        yield number, kind, value


def _varints(data: memoryview) -> np.ndarray:
    """All numbers of a packed list."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    if not last[-1]:
        raise ValueError("a packed list is cut off")
    begin = np.append(0, np.flatnonzero(last)[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    if place.max() > 9:
        raise ValueError("a number is too long")
    return np.bitwise_or.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin).view(np.int64)


def _feature(data: memoryview) -> Feature | None:
    found: Feature | None = None
    for number, _, value in fields(data):
        kind = KINDS.get(number)
        if kind is None:
            continue
        if kind == "bytes":
            found = kind, [bytes(v) for n, _, v in fields(value) if n == 1]
            continue
        parts = []
        for n, wire, v in fields(value):
            if n == 1:
                one = wire != 2
                parts.append((np.array([v & (1 << 64) - 1], np.uint64).view(np.int64) if one else _varints(v)) if kind == "int" else np.frombuffer(v, "<f4"))
        found = kind, np.concatenate(parts) if parts else np.zeros(0, np.int64 if kind == "int" else np.float32)
    return found


def parsed(record: bytes) -> dict[str, Feature]:
    """The features of a record by name; one without a list is left out. Of a repeated name the last counts."""
    out = {}
    for number, _, message in fields(memoryview(record)):
        if number != 1 or isinstance(message, int):
            continue
        for entry, _, pair in fields(message):
            if entry != 1 or isinstance(pair, int):
                continue
            name, feature = "", None
            for n, _, v in fields(pair):
                if n == 1:
                    name = bytes(v).decode()
                elif n == 2:
                    feature = _feature(v)
            if feature is not None:
                out[name] = feature
    return out


def _message(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def record(features: Mapping[str, Feature]) -> bytes:
    """The features in name order, so that equal rows give equal bytes."""
    entries = b""
    for name in sorted(features):
        kind, values = features[name]
        if kind == "bytes":
            body = b"".join(_message(1, bytes(v)) for v in values)
        else:
            body = _message(1, np.asarray(values, "<f4").tobytes() if kind == "float" else b"".join(varint(int(v)) for v in values))
        entries += _message(1, _message(1, name.encode()) + _message(2, _message(NUMBERS[kind], body)))
    return _message(1, entries)


def framed(payload: bytes, crcs: tuple[int, int]) -> bytes:
    """A record as a file holds it: length, its masked sum, the payload, its masked sum."""
    return struct.pack("<QI", len(payload), crcs[0]) + payload + struct.pack("<I", crcs[1])
