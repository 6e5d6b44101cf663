"""Record files of trajectories as a Spark data source: `spark.read.format("trajectory_records")`.

A file is a chain of records, each with its length and two checksums, and holds no index and no marks to split at: a file is read by one task, in a stream that
holds one batch, and small files share a task. Paths are opened on the executors by pyarrow's file systems (local, HDFS and object stores).

Damaged records follow Spark's own modes: PERMISSIVE (the default) gives each a row with nulls and what was wrong with it in the column `_corrupt_record`, if the
schema has that; DROPMALFORMED leaves them out; FAILFAST ends the job. After a damaged length the reader looks for the next place whose length fits its checksum.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from trajecta.functions import crc, examples

FORMAT = "trajectory_records"
CORRUPT = "_corrupt_record"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
BATCH_BYTES = 4 << 20
BLOCK = 1 << 20
HEADER = 12


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Stream:
    """A file's bytes in order, with as many at hand as are asked for."""

    def __init__(self, source, at: int = 0):
        self.source, self.held, self.at = source, bytearray(), at

    def have(self, n: int) -> int:
        """Fill up to n bytes; how many there are."""
        while len(self.held) < n:
            more = self.source.read(max(BLOCK, n - len(self.held)))
            if not more:
                break
            self.held += more
        return len(self.held)

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out


def _next_header(stream: Stream) -> None:
    """Skip to the next place whose length fits its checksum, or to the end."""
    stream.take(1)
    while stream.have(BLOCK) >= HEADER:
        data = np.frombuffer(bytes(stream.held), np.uint8)
        sums = sum(data[8 + k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
        hits = np.flatnonzero(crc.masked_windows(data[: len(data) - 4]) == sums)
        if len(hits):
            stream.take(int(hits[0]))
            return
        stream.take(len(data) - HEADER + 1)
    stream.take(stream.have(HEADER))


def payloads(source, size: int) -> Iterator[list[tuple[bytes | None, str]]]:
    """Batches of (payload, "") or (None, what is wrong) of a file of this size."""
    stream, batch, sums, held = Stream(source), [], [], 0

    def checked() -> list[tuple[bytes | None, str]]:
        whole = [i for i, (p, _) in enumerate(batch) if p is not None]
        found = crc.masked(crc.crc32c_many([batch[i][0] for i in whole]))
        for i, got in zip(whole, found.tolist()):
            if got != sums[i]:
                batch[i] = None, f"{batch[i][1]}: checksum of the data"
        return [(p, "" if p is not None else why) for p, why in batch]

    while stream.have(HEADER):
        at = stream.at
        header = bytes(stream.held[:HEADER])
        good = len(header) == HEADER and int(crc.masked(crc.crc32c(header[:8]))) == struct.unpack("<I", header[8:])[0]
        length = struct.unpack("<Q", header[:8])[0] if good else 0
        if not good or at + HEADER + length + 4 > size:
            _next_header(stream)
            batch.append((None, f"bytes {at} to {stream.at}: {'the file ends within the record' if good or len(header) < HEADER else 'checksum of the length'}"))
            sums.append(0)
            continue
        stream.have(HEADER + length + 4)
        stream.take(HEADER)
        batch.append((stream.take(length), f"bytes {at} to {at + HEADER + length + 4}"))
        sums.append(struct.unpack("<I", stream.take(4))[0])
        held += length
        if held >= BATCH_BYTES or len(batch) >= 10_000:
            yield checked()
            batch, sums, held = [], [], 0
    if batch:
        yield checked()


def _kind(field: T.StructField) -> tuple[str, bool]:
    """The kind of list that a column is, and whether it is one element of it."""
    element = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
    for kinds, name in (((T.FloatType, T.DoubleType), "float"), ((T.LongType, T.IntegerType), "int"), ((T.BinaryType, T.StringType), "bytes")):
        if isinstance(element, kinds):
            return name, not isinstance(field.dataType, T.ArrayType)
    raise ValueError(f"column {field.name} of type {field.dataType.simpleString()} is no feature: it takes float, double, bigint, int, binary or string, or an array of one")


def _value(found: examples.Feature | None, field: T.StructField) -> object:
    """A column's value of a feature; null if it is not there."""
    if found is None:
        return None
    kind, one = _kind(field)
    values = found[1] if found[0] == "bytes" else found[1].tolist()
    if found[0] != kind:
        if len(values):
            raise ValueError(f"{field.name} is a list of {found[0]}, not of {kind}")
        values = []
    element = field.dataType if one else field.dataType.elementType
    if isinstance(element, T.StringType):
        values = [v.decode() for v in values]
    if not one:
        return values
    if len(values) > 1:
        raise ValueError(f"{field.name} has {len(values)} elements, not one")
    return values[0] if len(values) else None


@dataclass
class Files(InputPartition):
    """Files that one task reads, with their sizes."""

    paths: tuple[tuple[str, int], ...]


class RecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema, self.root = schema, options["path"]
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.limit = int(options.get("partitionBytes", 128 << 20))
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        for f in schema.fields:
            if f.name != CORRUPT:
                _kind(f)

    def partitions(self) -> list[InputPartition]:
        """Files in path order, put together up to partitionBytes; names that begin with _ or . are not data."""
        from pyarrow import fs

        system, root = _opened(self.root)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "_."]
        out, now, held = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if now and held + f.size > self.limit:
                out.append(Files(tuple(now)))
                now, held = [], 0
            now.append((f.path, f.size))
            held += f.size
        return [*out, Files(tuple(now))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _opened(self.root)
        schema, fields = to_arrow_schema(self.schema), self.schema.fields
        for path, size in partition.paths:
            with system.open_input_stream(path) as source:
                for batch in payloads(source, size):
                    columns: list[list] = [[] for _ in fields]
                    for payload, why in batch:
                        row = None
                        if payload is not None:
                            try:
                                features = examples.parsed(payload)
                                row = [None if f.name == CORRUPT else _value(features.get(f.name), f) for f in fields]
                            except ValueError as e:
                                why = f"not a record of this schema: {e}"
                        if row is None:
                            if self.mode == "FAILFAST":
                                raise ValueError(f"damaged record in {path}, {why}")
                            if self.mode == "DROPMALFORMED":
                                continue
                            row = [f"{path}, {why}" if f.name == CORRUPT else None for f in fields]
                        for column, v in zip(columns, row):
                            column.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    made: str
    path: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    """A file for each task: written below _temporary, moved when all tasks have succeeded, so that a lost or repeated task leaves nothing behind."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str], overwrite: bool):
        self.schema, self.root, self.overwrite, self.job = schema, options["path"], overwrite, uuid.uuid4().hex
        for f in schema.fields:
            _kind(f)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.root)
        name = f"part-{uuid.uuid4().hex}.records"
        made, count, out = f"{root}/_temporary-{self.job}/{name}", 0, None
        kinds = [(f.name, *_kind(f)) for f in self.schema.fields]
        for batch in batches:
            rows = [examples.record({name: self._feature(kind, one, v) for (name, kind, one), v in zip(kinds, row) if v is not None}) for row in zip(*(c.to_pylist() for c in batch.columns))] if batch.num_columns else []
            if not rows:
                continue
            if out is None:
                system.create_dir(f"{root}/_temporary-{self.job}", recursive=True)
                out = system.open_output_stream(made)
            lengths = crc.masked(crc.crc32c_many([struct.pack("<Q", len(r)) for r in rows])).tolist()
            out.write(b"".join(examples.framed(r, sums) for r, sums in zip(rows, zip(lengths, crc.masked(crc.crc32c_many(rows)).tolist()))))
            count += len(rows)
        if out is None:
            return Written("", "", 0)
        out.close()
        return Written(made, f"{root}/{name}", count)

    @staticmethod
    def _feature(kind: str, one: bool, value: object) -> examples.Feature:
        values = [value] if one else value
        if any(v is None for v in values):
            raise ValueError("a feature's list cannot hold nulls")
        return kind, [v.encode() if isinstance(v, str) else v for v in values] if kind == "bytes" else values

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.root)
        old = [f.path for f in self._there(system, root)] if self.overwrite else []
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.records:
                system.move(m.made, m.path)
        for path in old:
            system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.root))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary-{self.job}")

    @staticmethod
    def _there(system, root: str) -> list:
        from pyarrow import fs

        return [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(".records")]


class RecordSource(DataSource):
    """Options: path (a file or folder), mode, partitionBytes. The schema is the user's: a column for each feature that is wanted."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        raise ValueError("name the features with .schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(schema, self.options, overwrite)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "PERMISSIVE") -> DataFrame:
    """Records of a file or of all files below a folder; see the module for damaged ones."""
    spark.dataSource.register(RecordSource)
    return spark.read.format(FORMAT).schema(schema).option("mode", mode).load(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A record for each row. Null columns are left out of their record."""
    df.sparkSession.dataSource.register(RecordSource)
    df.write.format(FORMAT).mode(mode).save(path)


def steps(trajectories: DataFrame, widths: Mapping[str, int], keys: Mapping[str, str] | None = None, step: str = "t") -> DataFrame:
    """A row for each step of trajectories whose features are stored flat: keys (new name to column), step, and of each feature its `width` values of that
    step (an array; of width 0 the one value itself). All features of a trajectory must have the same number of steps; a null one is null in each step."""
    if not widths:
        raise ValueError("no features")
    keys = keys or {}
    sizes = F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.size(f"`{c}`") / max(w, 1)) for c, w in widths.items())))
    n = F.coalesce(F.array_max(sizes), F.lit(0.0))
    even = (n == F.coalesce(F.array_min(sizes), F.lit(0.0))) & (n == F.floor(n))
    n = F.when(even, n.cast("int")).otherwise(F.raise_error(F.concat(F.lit("features of unequal length: "), F.to_json(sizes))).cast("int"))

    def one(t):
        part = lambda c, w: F.get(f"`{c}`", t) if w == 0 else F.slice(f"`{c}`", t * w + 1, w)
        return F.struct(t.alias(step), *(part(c, w).alias(c) for c, w in widths.items()))

    # The flat arrays stay behind: a generator that carried them would copy them into every step.
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))
    made = trajectories.select(*(F.col(f"`{c}`").alias(k) for k, c in keys.items()), rows.alias("_steps"))
    return made.select(*keys, F.explode("_steps").alias("_step")).select(*keys, "_step.*")
