"""Baseline JPEG as a media column: marker parsing, Huffman scans, and DC-only luminance thumbnails, in numpy.

Files are decoded in lockstep: all restart intervals of all files that share their tables and sampling advance by one Huffman
code per numpy step. `decode` reads any baseline file with interleaved components of 8 bits; `thumbnails` keeps only the DC
values of the first component. `store` writes bytes losslessly: each byte, less 128, is one quantised coefficient (the unit of
the format), 192 to an MCU of three blocks, with a restart marker after each MCU.

Defined results: null and empty text are the empty payload, that is 192 spaces; a row of a media column that is null or no
baseline JPEG gets null dimensions and hashes; equal bytes give equal results; other columns are not read. Texts are taken whole, about 2 MB
at a time, and memory is bounded by the longest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import text as tx
from trajecta.llm.tables import replaced

MCU_BYTES = 192

# The zigzag order is not needed, as coefficients are stored and read in scan order.
# Code lengths by size of a coefficient after no zeros, for text: lower case letters have size 5 and 4, spaces 7.
AC_BITS = {0x05: 1, 0x04: 2, 0x07: 3, 0x06: 4, 0x03: 5, 0x08: 6, 0x00: 7, 0xF0: 8, 0x02: 10, 0x01: 10}
DC_BITS = {5: 1, 4: 2, 7: 3, 6: 4, 3: 5, 8: 6, 2: 7, 1: 8, 0: 9}


def canonical(bits: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and (code, length) of each symbol, as JPEG assigns them."""
    order = sorted(bits, key=lambda s: (bits[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= bits[s] - last
        last = bits[s]
        codes[s] = (code, last)
        code += 1
    return [sum(b == n for b in bits.values()) for n in range(1, 17)], order, codes


def _tables():
    ac = AC_BITS | {run << 4 | size: 16 for run in range(1, 16) for size in range(1, 9)}
    (dc_counts, dc_order, dc_codes), (ac_counts, ac_order, ac_codes) = canonical(DC_BITS), canonical(ac)
    code, length = np.zeros((2, 256), np.uint64), np.zeros((2, 256), np.int64)
    for k, codes in enumerate((dc_codes, ac_codes)):
        for s, (c, n) in codes.items():
            code[k, s], length[k, s] = c, n
    dht = b"".join(struct.pack(">HHB", 0xFFC4, 19 + len(order), kind) + bytes(counts) + bytes(order) for kind, counts, order in ((0x00, dc_counts, dc_order), (0x10, ac_counts, ac_order)))
    return code, length, dht


_CODE, _LENGTH, _DHT = _tables()
_DQT = struct.pack(">HHB", 0xFFDB, 67, 0) + b"\x01" * 64
_VALUE = np.arange(256) - 128
_SIZE = np.array([int(abs(v)).bit_length() for v in _VALUE])
_EXTRA = np.where(_VALUE < 0, _VALUE + (1 << _SIZE) - 1, _VALUE).astype(np.uint64)


def _layout(mcus: int) -> tuple[int, int]:
    columns = int(np.ceil(np.sqrt(mcus)))
    return columns, -(-mcus // columns)


def _header(columns: int, rows: int, payload: int) -> bytes:
    note = b"payload %d" % payload
    frame = struct.pack(">HHBHHB", 0xFFC0, 17, 8, 8 * rows, 8 * columns, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = struct.pack(">HHB", 0xFFDA, 12, 3) + bytes([1, 0, 2, 0, 3, 0, 0, 63, 0])
    return b"\xff\xd8" + struct.pack(">HH", 0xFFFE, 2 + len(note)) + note + _DQT + frame + _DHT + struct.pack(">HHH", 0xFFDD, 4, 1) + scan


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length for each coefficient of blocks of 64 bytes; zeros have length 0, but for run and end codes."""
    blocks = values.reshape(-1, 64)
    size = _SIZE[values]
    symbol = size.copy()
    dc = np.zeros(64, np.int64)
    dc[0] = 1
    kind = np.broadcast_to(1 - dc, blocks.shape).ravel()
    zeros = np.flatnonzero(((blocks == 128).any(axis=1)))
    emits = np.ones(len(values), bool)
    if len(zeros):
        symbols, emit = symbol.reshape(-1, 64)[zeros], np.ones((len(zeros), 64), bool)
        sub = blocks[zeros]
        run = np.zeros(len(zeros), np.int64)
        for k in range(1, 64):
            zero = sub[:, k] == 128
            emit[zero, k] = False
            symbols[~zero, k] |= (run[~zero] % 16) << 4
            for j in range(3):  # a code for 16 zeros stands at the last of them
                long = np.flatnonzero(~zero & (run >= 16 * (j + 1)))
                at = k - run[long] + 16 * j + 15
                symbols[long, at], emit[long, at] = 0xF0, True
            run = np.where(zero, run + 1, 0)
        ends = np.flatnonzero(run)
        symbols[ends, 63], emit[ends, 63] = 0, True
        symbol.reshape(-1, 64)[zeros] = symbols
        emits.reshape(-1, 64)[zeros] = emit
    code, length = _CODE[kind, symbol], _LENGTH[kind, symbol]
    code = (code << size.astype(np.uint64)) | _EXTRA[values]
    return np.where(emits, code, 0), np.where(emits, length + size, 0)


def store(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One file for each payload raw[at[i]:at[i+1]]; every length is a positive multiple of 192."""
    mcus = np.diff(at) // MCU_BYTES
    shapes = [_layout(int(m)) for m in mcus]
    full = np.array([c * r for c, r in shapes])
    if (full != mcus).any():
        parts = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            parts += [raw[a:b], np.full((full[i] - mcus[i]) * MCU_BYTES, 128, np.uint8)]
        raw = np.concatenate(parts)
    code, length = _codes(raw)
    bits = length.reshape(-1, MCU_BYTES).sum(axis=1)
    size = (bits + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    begin = np.cumsum(length) - length
    begin += np.repeat(first[:-1] * 8 - begin[::MCU_BYTES], MCU_BYTES)
    word = begin >> 5
    wide = code << (64 - (begin & 31) - length).astype(np.uint64)
    wide[length == 0] = 0
    out = np.zeros(int(first[-1]) // 4 + 3, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out[word[starts]] |= np.add.reduceat(wide >> np.uint64(32), starts)
    out[word[starts] + 1] |= np.add.reduceat(wide & np.uint64(0xFFFFFFFF), starts)
    stream = out.astype(">u4").view(np.uint8)[: first[-1]]
    stream[first[1:] - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)
    # Room for the zero after each 0xFF and for a marker of two bytes before each MCU; the first marker of a file is cut off again.
    room = np.zeros(len(stream), np.int64)
    stuffed = np.flatnonzero(stream == 255)
    room[stuffed[stuffed + 1 < len(stream)] + 1] += 1
    room[first[:-1]] += 2
    place = np.arange(len(stream)) + np.cumsum(room)
    last = int(place[-1]) + 1 + int(stream[-1] == 255)
    body = np.zeros(last, np.uint8)
    body[place] = stream
    number = np.arange(len(mcus)).repeat(full)
    offset = np.concatenate([[0], np.cumsum(full)])
    marker = place[first[:-1]] - 2
    body[marker] = 255
    body[marker + 1] = 0xD0 + (np.arange(len(number)) - offset[number] - 1) % 8
    edge = np.append(marker[offset[:-1]], last)
    data = body.tobytes()
    return [_header(*shapes[i], int(at[i + 1] - at[i])) + data[edge[i] + 2 : edge[i + 1]] + b"\xff\xd9" for i in range(len(mcus))]


@dataclass
class Frame:
    """What the markers of one file say."""

    width: int = 0
    height: int = 0
    note: bytes = b""
    restart: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    scan: list[tuple[int, int]] = field(default_factory=list)
    data: tuple[int, int] = (0, 0)

    @property
    def pattern(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.parts) == 1:
            return [0]
        return [i for i, (_, h, v, _) in enumerate(self.parts) for _ in range(h * v)]

    @property
    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = (1, 1) if len(self.parts) == 1 else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Frame | None:
    """The frame of a baseline file, or None for anything else."""
    frame, at = Frame(), 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                frame.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                frame.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC0:
            if body[0] != 8:
                return None
            frame.height, frame.width = struct.unpack(">HH", body[1:5])
            frame.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            return None
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            frame.note = body
        elif marker == 0xDA:
            if not frame.parts or body[0] != len(frame.parts):
                return None
            frame.scan = [(body[i + 1] >> 4, 0x10 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            end = data.rfind(b"\xff\xd9")
            frame.data = (at + 2 + size, end if end > at else len(data))
            return frame
        at += 2 + size
    return None


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that may come next; length 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for symbol in table[at : at + table[n - 1]]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
            code += 1
        at += table[n - 1]
        code <<= 1
    return out


def _group(files: list[bytes], frames: list[Frame], dc_only: bool) -> list[np.ndarray | None]:
    """Coefficients [block, 64] (or DC values [block]) in scan order of files that share tables, sampling and restart interval."""
    one = frames[0]
    pattern = np.array(one.pattern)
    luts = [_lookup(one.huffman[t]) for part in one.scan for t in part]
    lut = np.concatenate(luts)
    raw = np.frombuffer(b"".join(f[g.data[0] : g.data[1]] + b"\xff\xd9" for f, g in zip(files, frames)), np.uint8)
    ends = np.cumsum([g.data[1] - g.data[0] + 2 for g in frames])
    after = np.append(raw[1:], 0)
    ff = raw == 255
    mark = ff & (after >= 0xD0) & (after <= 0xD9)
    keep = ~mark
    keep[1:] &= ~((raw[1:] == 0) & ff[:-1]) & ~mark[:-1]
    kept = np.cumsum(keep) - keep
    cuts = np.flatnonzero(mark)
    starts = np.concatenate([[0], cuts[:-1] + 2])
    owner = np.searchsorted(ends, starts, "right")
    begin = kept[np.minimum(starts, len(kept) - 1)]
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    total = np.array([int(np.prod(g.grid)) for g in frames])
    count = np.bincount(owner, minlength=len(files))
    within = np.arange(len(starts)) - (np.cumsum(count) - count)[owner]
    per = one.restart or int(total.max())
    mcus = np.clip(total[owner] - within * per, 0, per)
    blocks = mcus * len(pattern)
    base = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()) if dc_only else (int(blocks.sum()), 64), np.int16)
    bit, block, k = begin.astype(np.int64) * 8, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    dc = np.zeros((len(starts), len(one.parts)), np.int64)
    live = np.flatnonzero(blocks)
    bad = np.zeros(len(files), bool)
    limit = 8 * (len(clean) - 8)
    while len(live):
        past = bit[live] >= limit
        p = np.minimum(bit[live], limit)
        part = pattern[block[live] % len(pattern)]
        kk = k[live]
        x = (window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        got = lut[(2 * part + (kk > 0)) << 16 | (x >> np.uint64(16)).astype(np.int64)]
        length, symbol = got >> 8, got & 255
        size, run = symbol & 15, symbol >> 4
        extra = ((x << length.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> (32 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        wrong = (length == 0) | past
        first = kk == 0
        if first.any():
            rows = live[first]
            dc[rows, part[first]] += value[first]
            value[first] = dc[rows, part[first]]
            run = np.where(first, 0, run)
        to = kk + run
        end = ~first & (symbol == 0)
        wrong |= ~end & (to > 63)
        write = (first | (size > 0)) & ~wrong
        if dc_only:
            write &= first
            out[base[live[write]] + block[live[write]]] = value[write]
        else:
            out[base[live[write]] + block[live[write]], to[write]] = value[write]
        bit[live] = p + length + size
        to = np.where(end, 64, to + 1)
        done = to > 63
        k[live] = np.where(done, 0, to)
        block[live] += done
        if wrong.any():
            bad[owner[live[wrong]]] = True
            block[live[wrong]] = blocks[live[wrong]]
        if done.any():
            live = live[block[live] < blocks[live]]
    edge = np.concatenate([[0], np.cumsum(np.bincount(owner, blocks, len(files)).astype(np.int64))])
    want = total * len(pattern)
    return [None if bad[i] or edge[i + 1] - edge[i] != want[i] else out[edge[i] : edge[i + 1]] for i in range(len(files))]


def decode(files: list[bytes], dc_only: bool = False) -> list[tuple[Frame, np.ndarray] | None]:
    """Frame and quantised coefficients in scan order of each baseline file; None for anything else."""
    frames = [parse(f) if f else None for f in files]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, g in enumerate(frames):
        if g is not None and all(t in g.huffman for s in g.scan for t in s) and all(p[3] in g.quant for p in g.parts):
            groups[tuple(sorted(g.huffman.items())), tuple(g.parts), tuple(g.scan), g.restart].append(i)
    out: list = [None] * len(files)
    for rows in groups.values():
        for i, values in zip(rows, _group([files[i] for i in rows], [frames[i] for i in rows], dc_only)):
            if values is not None:
                out[i] = frames[i], values
    return out


def thumbnail(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """One luminance pixel for each 8 x 8 block, from the DC values of all blocks in scan order."""
    across, down = frame.grid
    pattern = frame.pattern
    _, h, v, q = frame.parts[0]
    if len(frame.parts) == 1:
        h = v = 1
    luma = dc.reshape(down, across, len(pattern))[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    luma = luma[: -(-frame.height // 8), : -(-frame.width // 8)]
    return np.clip(np.rint(luma * int(frame.quant[q][0]) / 8) + 128, 0, 255).astype(np.uint8)


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8 x 8 sampled pixels are brighter than their mean."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(8) * pixels.shape[1] // 8
    small = pixels[np.ix_(rows, columns)].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()


def feature(frame: Frame, dc: np.ndarray) -> str:
    pixels = thumbnail(frame, dc)
    return f"{frame.width}x{frame.height}:{average_hash(pixels)}:{zlib.crc32(pixels.tobytes()):08x}"


def padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with spaces up to a positive multiple of 192 bytes."""
    size = np.diff(at)
    full = np.maximum(1, -(-size // MCU_BYTES)) * MCU_BYTES
    edge = np.concatenate([[0], np.cumsum(full)])
    out = np.full(edge[-1], 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(edge[:-1] - at[:-1], size)] = raw
    return out, edge


def to_media(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_bytes, media: each row's whole text as one JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, column):
            files = store(*padded(raw, at))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(files, pa.binary())], [key, "n_bytes", "media"])

    return df.select(F.col(key), F.col(column).alias(column)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def media_features(df: DataFrame, column: str = "media") -> DataFrame:
    """Any table's JPEG column read: its other columns, and width, height, thumb_hash (hex), feature; null for other bytes.

    Columns that have a new name are replaced."""
    new = ["width", "height", "thumb_hash", "feature"]
    df = replaced(df, new, column)
    rest = [f for f in df.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in tx.slices(batches, column):
            files = rows.column(rows.schema.get_field_index(column)).to_pylist()
            found = decode(files, dc_only=True)
            texts = [None if x is None else feature(*x) for x in found]
            columns = [rows.column(rows.schema.get_field_index(f.name)) for f in rest]
            new_columns = [pa.array([x and x[0].width for x in found], pa.int32()), pa.array([x and x[0].height for x in found], pa.int32()), pa.array([x and x.split(":")[1] for x in texts], pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + new_columns, [f.name for f in rest] + new)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(column)).mapInArrow(run, f"{schema}{', ' if rest else ''}width int, height int, thumb_hash string, feature string")


def read_media(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The payloads read back from to_media's files, with digests of payload and file, and the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, "media"):
            files = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            out = defaultdict(list)
            for data, found in zip(files, decode(files)):
                if found is None:
                    raise ValueError("a stored file does not decode")
                frame, values = found
                payload = (values.reshape(-1)[: int(frame.note.split()[1])] + 128).astype(np.uint8).tobytes()
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(feature(frame, values[:, 0]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, out.values())], [key, "n_bytes", *out])

    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
