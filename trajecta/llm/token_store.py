"""Token ids in binary blocks, one zstandard frame for each document, with one dictionary for all.

A block is: magic, bytes to an id, documents, SHA-256 of the dictionary; then the documents' keys (int64), one byte each that is 1 if the key
is null, token counts (int64) and the offset index (int64, one more than documents); then the frames. Any document is read by its two offsets, without the others.
Blocks are rows of a Parquet table in ascending key order with their least and greatest key, so `lookup` reads only those that can hold a key.
Spark's commit protocol covers lost executors; the dictionary is stored once beside them, and a reader refuses a block whose dictionary hash differs.

Defined results: null and empty text are the end id alone; equal keys stand in the order of their texts, nulls first; null keys come first and stay null; a table
without rows gives a store without blocks; texts are whole at any length. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajecta.llm import text as tx
from trajecta.llm import tokens
from trajecta.llm.tables import stored

MAGIC = b"TOKB2\0"
HEAD = struct.Struct("<6sHI32s")
BLOCKS = "part int, block int, part_start long, n_docs int, n_tokens long, low long, high long, n_null int, data binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


@functools.lru_cache(maxsize=4)
def _codec(dictionary: bytes, level: int):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d)


def train_dictionary(docs: DataFrame, path: str, end_id: int, key: str, column: str, piece: int, size: int) -> bytes:
    """A dictionary trained on pieces of `piece` characters from all over all texts, chosen by hash so that there are about 100 bytes
    of ids (200 characters) to each byte of the dictionary, or the whole texts if they are shorter. Of samples that are too few for the
    trainer the dictionary is made by joining them; there is none only if there are no documents."""
    length = F.length(column)
    total = docs.agg(F.sum(length)).first()[0] or 0
    last = F.greatest(F.lit(0), F.floor((F.coalesce(F.col("_length"), F.lit(0)) - 1) / piece)).cast("int")
    numbers = F.sequence(F.lit(0), last)
    if total > 200 * size:
        bound = int((1 << 40) * 200 * size / total)
        numbers = F.filter(numbers, lambda n: F.pmod(F.xxhash64("_hash", n), F.lit(1 << 40)) < bound)
    texts = docs.select(F.col(column).alias("_text"), length.alias("_length"), F.xxhash64(key, column).alias("_hash"))
    chosen = texts.withColumn("_numbers", numbers).where(F.size("_numbers") > 0).withColumn("_n", F.explode("_numbers"))
    chosen = chosen.select(F.substring("_text", F.col("_n") * piece + 1, F.lit(piece)).alias("text"), (F.col("_n") == last).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.loaded(path)
        kind = f"<u{_width(encoder.library.get_vocab_size())}"
        for rows, raw, at in tx.slices(batches, "text", tokens.SLICE_BYTES):
            flat, edge = encoder.encode(raw, at)
            ends = rows.column(rows.schema.get_field_index("last")).to_pylist()
            ids = [np.append(flat[a:b], end_id) if end else flat[a:b] for a, b, end in zip(edge[:-1].tolist(), edge[1:].tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["ids"])

    samples = sorted((bytes(r[0]) for r in chosen.mapInArrow(run, "ids binary").collect()), key=lambda x: hashlib.sha256(x).digest())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(samples).ljust(8, b"\0")[-size:]


def pack_block(keys: list[int | None], ids: list[np.ndarray], dictionary: bytes, width: int, level: int = 3) -> bytes:
    compress, _ = _codec(dictionary, level)
    frames = [compress.compress(x.astype(f"<u{width}").tobytes()) for x in ids]
    index = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8")
    counts = np.array([len(x) for x in ids], "<i8")
    numbers, nulls = np.array([0 if k is None else k for k in keys], "<i8"), bytes(k is None for k in keys)
    return b"".join([HEAD.pack(MAGIC, width, len(keys), hashlib.sha256(dictionary).digest()), numbers.tobytes(), nulls, counts.tobytes(), index.tobytes(), *frames])


class Block:
    """A packed block opened for reading."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, n, digest = HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a block of this dictionary")
        at = HEAD.size
        self.keys = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, np.uint8, n, at + 8 * n) > 0
        self.counts = np.frombuffer(data, "<i8", n, at + 9 * n)
        self.index = np.frombuffer(data, "<i8", n + 1, at + 17 * n)
        self.frames = memoryview(data)[at + 25 * n + 8 :]
        self.codec = _codec(dictionary, 3)[1]

    def __len__(self) -> int:
        return len(self.keys)

    def key_column(self) -> pa.Array:
        return pa.array(self.keys, mask=self.nulls)

    def ids(self, n: int) -> np.ndarray:
        return np.frombuffer(self.codec.decompress(self.frames[self.index[n] : self.index[n + 1]]), f"<u{self.width}")


def write(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", column: str = "text", *, piece: int = 4096, dictionary_bytes: int = 32_768, level: int = 3) -> tuple[DataFrame, bytes]:
    """The stored block table and its dictionary. The dictionary is trained on a sample from all over the texts; every document is written."""
    dictionary = train_dictionary(docs, path, end_id, key, column, piece, dictionary_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.loaded(path)
        width = _width(encoder.library.get_vocab_size())
        part, start = TaskContext.get().partitionId(), 0
        kinds = [pa.int32() if c.endswith(" int") else pa.binary() if c.endswith(" binary") else pa.int64() for c in BLOCKS.split(", ")]
        for n, (rows, raw, at) in enumerate(tx.slices(batches, column, tokens.SLICE_BYTES)):
            flat, edge = encoder.encode(raw, at)
            ids = [np.append(flat[a:b], end_id) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            total = sum(map(len, ids))
            keys = rows.column(0).to_pylist()
            known = [k for k in keys if k is not None]
            low, high = (min(known), max(known)) if known else (None, None)
            values = [part, n, start, len(ids), total, low, high, len(keys) - len(known), pack_block(keys, ids, dictionary, width, level)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], NAMES)
            start += total

    ordered = docs.select(F.col(key), F.col(column).alias(column)).repartitionByRange(key).sortWithinPartitions(key, column)
    return stored(ordered.mapInArrow(run, BLOCKS), "tokens"), dictionary


def read(blocks: DataFrame, dictionary: bytes, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids array<int> of every stored document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_start, base, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = Block(data, dictionary)
                ids = [block.ids(i) for i in range(len(block))]
                edge = np.concatenate([[0], np.cumsum(block.counts)])
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([block.key_column(), pa.array(edge[:-1] + part_start + base), pa.array(block.counts), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), flat)], [key, "start", "n_tokens", "ids"])

    return _based(blocks).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids array<int>")


def _based(blocks: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Blocks with the number of tokens in all partitions before theirs. There is one row for each write task; up to `most` of them
    (16 MB) are broadcast, beyond that they are joined."""
    before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    totals = blocks.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("n")).select("of", F.coalesce(before, F.lit(0)).alias("base"))
    if (blocks.agg(F.max("part")).first()[0] or 0) < most:
        totals = F.broadcast(totals)
    return blocks.join(totals, F.col("part") == F.col("of")).select("part_start", "base", "data")


def checksums(blocks: DataFrame, dictionary: bytes, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 (over little-endian 32-bit ids), from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_start, base, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = Block(data, dictionary)
                crc = [zlib.crc32(block.ids(i).astype("<u4").tobytes()) for i in range(len(block))]
                first = np.cumsum(block.counts) - block.counts + part_start + base
                yield pa.RecordBatch.from_arrays([block.key_column(), pa.array(first), pa.array(block.counts), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return _based(blocks).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def lookup(blocks: DataFrame, dictionary: bytes, key: int | None) -> DataFrame:
    """ids array<int> of each document with one key, by the offset index, from the blocks that can hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                block = Block(data, dictionary)
                found = np.flatnonzero(block.nulls if key is None else (block.keys == key) & ~block.nulls)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([block.ids(int(i)).tolist() for i in found], pa.list_(pa.int32()))], ["ids"])

    wanted = F.col("n_null") > 0 if key is None else (F.col("low") <= key) & (F.col("high") >= key)
    return blocks.where(wanted).select("data").mapInArrow(run, "ids array<int>")
