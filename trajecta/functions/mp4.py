"""The boxes of an MP4 file: where each frame of a video track is, when it is shown, and whether it stands alone. Frames stay encoded.

`muxed` writes the plain form of such a file, one video track with its index before the data, and is what tests and queries read back. Files whose index is
spread over fragments are not read: they are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Track:
    """One row for each frame, in the order in which they are shown."""

    codec: str
    width: int
    height: int
    offset: np.ndarray
    size: np.ndarray
    time: np.ndarray
    key: np.ndarray


def boxes(data: memoryview, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """Name, and where the content begins and ends, of the boxes one after another."""
    at, end = begin, len(data) if end is None else end
    while at < end:
        if at + 8 > end:
            raise ValueError(f"a box at byte {at} is cut off")
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"a box at byte {at} is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {name.decode('latin-1')} at byte {at} does not fit")
        yield name.decode("latin-1"), at + head, at + size
        at += size


def _inner(data: memoryview, begin: int, end: int, *path: str) -> tuple[int, int] | None:
    """The content of the first box below, by names."""
    for name in path:
        found = next(((b, e) for n, b, e in boxes(data, begin, end) if n == name), None)
        if found is None:
            return None
        begin, end = found
    return begin, end


def _entries(data: memoryview, where: tuple[int, int] | None, kinds: str) -> np.ndarray | None:
    """A counted table after version and flags, as columns of big-endian numbers."""
    if where is None:
        return None
    begin, end = where
    (n,) = struct.unpack_from(">I", data, begin + 4)
    row = np.dtype([(f"f{i}", k) for i, k in enumerate(kinds.split())])
    if begin + 8 + n * row.itemsize > end:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, row, n, begin + 8)


def _run_of(lengths: np.ndarray, n: int, what: str) -> np.ndarray:
    """For each of n frames the number of the run that it is in. Nothing grows with the lengths, which a damaged file may have as it likes."""
    ends = np.cumsum(lengths.astype(np.int64))
    if not len(ends) or ends[-1] < n:
        raise ValueError(f"the {what} are of fewer frames than there are sizes")
    return np.searchsorted(ends, np.arange(n), "right")


def _track(data: memoryview, begin: int, end: int) -> Track | None:
    handler, clock = _inner(data, begin, end, "mdia", "hdlr"), _inner(data, begin, end, "mdia", "mdhd")
    stbl = _inner(data, begin, end, "mdia", "minf", "stbl")
    if handler is None or bytes(data[handler[0] + 8 : handler[0] + 12]) != b"vide":
        return None
    if clock is None or stbl is None:
        raise ValueError("a video track has no clock or no index")
    (scale,) = struct.unpack_from(">I", data, clock[0] + (20 if data[clock[0]] == 1 else 12))
    table = lambda name, kinds: _entries(data, _inner(data, *stbl, name), kinds)
    entry = _inner(data, *stbl, "stsd")
    if entry is None or scale == 0:
        raise ValueError("a video track has no description or no clock")
    codec = bytes(data[entry[0] + 12 : entry[0] + 16]).decode("latin-1")
    width, height = struct.unpack_from(">HH", data, entry[0] + 40)
    sizes = _inner(data, *stbl, "stsz")
    if sizes is None:
        raise ValueError("a video track has no frame sizes")
    fixed, n = struct.unpack_from(">II", data, sizes[0] + 4)
    if n * fixed > len(data) or not fixed and sizes[0] + 12 + 4 * n > sizes[1]:
        raise ValueError("a table is cut off")
    size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, sizes[0] + 12).astype(np.int64)
    chunks = table("stco", ">u4")
    chunks = table("co64", ">u8") if chunks is None else chunks
    runs, steps = table("stsc", ">u4 >u4 >u4"), table("stts", ">u4 >u4")
    if n and (chunks is None or runs is None or steps is None or not len(runs)):
        raise ValueError("a video track has frames but no places or times")
    if not n:
        return Track(codec, width, height, *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0), np.zeros(0, bool))
    # Each run of chunks has so many frames to a chunk; a frame is where its chunk begins, after the frames before it there.
    first = runs["f0"].astype(np.int64) - 1
    held = np.repeat(runs["f1"].astype(np.int64), np.diff(np.append(first, len(chunks))))
    chunk = _run_of(held, n, "chunks")
    before = np.cumsum(size) - size
    begins = np.append(0, np.cumsum(held))[chunk]
    offset = chunks["f0"].astype(np.int64)[chunk] + before - before[begins]
    if len(offset) and (offset + size).max() > len(data):
        raise ValueError("frames lie beyond the end of the file")
    spans = steps["f1"].astype(np.int64)[_run_of(steps["f0"], n, "times")]
    shown = np.cumsum(spans) - spans
    shift = table("ctts", ">u4 >i4")
    if shift is not None:
        shown = shown + shift["f1"].astype(np.int64)[_run_of(shift["f0"], n, "shifts")]
    keys = table("stss", ">u4")
    key = np.ones(n, bool) if keys is None else np.isin(np.arange(1, n + 1), keys["f0"])
    order = np.argsort(shown, kind="stable")
    return Track(codec, width, height, offset[order], size[order], shown[order] / scale, key[order])


def tracks(content: bytes) -> list[Track]:
    """The video tracks of a file, in its order. Anything that is not such a file is a ValueError."""
    data = memoryview(content)
    try:
        top = list(boxes(data))
        moov = next(((b, e) for n, b, e in top if n == "moov"), None)
        if moov is None:
            raise ValueError("no index")
        if any(n == "moof" for n, *_ in top):
            raise ValueError("the index is in fragments")
        return [t for n, b, e in boxes(data, *moov) if n == "trak" and (t := _track(data, b, e)) is not None]
    except (struct.error, IndexError) as e:
        raise ValueError(f"a box is cut off: {e}") from e


def _box(name: str, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), name.encode()) + body


def _full(name: str, *content: bytes) -> bytes:
    return _box(name, bytes(4), *content)


def _table(name: str, rows: Sequence[tuple[int, ...]], kinds: str) -> bytes:
    return _full(name, struct.pack(">I", len(rows)), *(struct.pack(">" + kinds, *r) for r in rows))


def muxed(frames: Sequence[bytes], fps: int, codec: str = "jpeg", width: int = 0, height: int = 0, keys: Sequence[int] | None = None, chunk: int = 8, shown: Sequence[int] | None = None) -> bytes:
    """A file of encoded frames at a constant rate, `chunk` to a chunk; keys are the numbers (from 0) of frames that stand alone, all if None; shown shifts when each is shown, in frames."""
    n, head = len(frames), _box("ftyp", b"isom", bytes(4), b"isom")
    places = list(range(0, n, chunk))
    begins = np.append(0, np.cumsum([len(f) for f in frames])).astype(int).tolist()
    runs = [(1, chunk, 1)] if n >= chunk else []
    if n % chunk:
        runs.append((len(places), n % chunk, 1))
    entry = _box(codec, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), bytes(50))

    def index(base: int) -> bytes:
        stbl = _box(
            "stbl",
            _full("stsd", struct.pack(">I", 1), entry),
            _table("stts", [(n, 1000)] if n else [], "II"),
            *([_table("ctts", [(1, 1000 * s) for s in shown], "Ii")] if shown is not None else []),
            *([_table("stss", [(k + 1,) for k in keys], "I")] if keys is not None else []),
            _table("stsc", runs, "III"),
            _full("stsz", struct.pack(">II", 0, n), *(struct.pack(">I", len(f)) for f in frames)),
            _table("co64", [(base + begins[p],) for p in places], "Q"),
        )
        clock = _full("mdhd", bytes(8), struct.pack(">II", 1000 * fps, 1000 * n), bytes(4))
        return _box("moov", _box("trak", _box("mdia", clock, _full("hdlr", bytes(4), b"vide", bytes(13)), _box("minf", stbl))))

    base = len(head) + len(index(0)) + 8
    return head + index(base) + _box("mdat", *frames)
