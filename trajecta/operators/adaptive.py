"""Statistics of vectors in one pass: mergeable histograms whose range grows with the data.

The two-pass form (operators.stats) knows the extremes before it counts. Where the data can be read only once, each batch becomes a histogram over its own range; two of them
are merged on the range of both, where the count of an old bin goes to the new bin that holds its left edge. That moves values down by less than one old bin, so the
result depends on the order of merging, which is fixed here: batches in order, FAN at a time, level by level. A state has a bounded size, whatever it has seen.

No count is lost: the first bin of a batch begins just below its least value, and goes to the first new bin when that is still the least. Null vectors are not counted;
null or non-finite components, and vectors of different lengths, are an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators.stats import BINS

FAN = 16
PAD = 1e-10


class Histogram:
    """Count, mean, mean of squares, extremes and bins of each dimension. `padded`: the edges are those of a first batch, a little beyond the extremes."""

    def __init__(self, n: int, mean: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray, padded: bool):
        self.n, self.mean, self.squares, self.low, self.high, self.counts, self.padded = n, mean, squares, low, high, counts, padded

    @property
    def edges(self) -> np.ndarray:
        """[dim][bin + 1]"""
        pad = PAD if self.padded else 0.0
        return np.linspace(self.low - pad, self.high + pad, self.counts.shape[1] + 1, axis=1)

    @classmethod
    def of(cls, batch: np.ndarray, bins: int = BINS) -> Histogram:
        """Of [row][dim] values, at least one row."""
        if not np.isfinite(batch).all():
            raise ValueError("a vector has a component that is null or not finite")
        low, high = batch.min(axis=0), batch.max(axis=0)
        out = cls(len(batch), batch.mean(axis=0), (batch**2).mean(axis=0), low, high, np.zeros((batch.shape[1], bins), np.int64), True)
        for d, edges in enumerate(out.edges):
            out.counts[d] = np.bincount(_bins(edges, batch[:, d]), minlength=bins)
        return out

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The counts on equal bins of a range that holds this one."""
        bins = self.counts.shape[1]
        new = np.linspace(low, high, bins + 1, axis=1)
        moved = [np.bincount(_bins(edges, old[:-1]), counts, bins) for edges, old, counts in zip(new, self.edges, self.counts)]
        return np.array(moved).astype(np.int64).reshape(self.counts.shape)

    def merged(self, other: Histogram) -> Histogram:
        if len(self.low) != len(other.low) or self.counts.shape != other.counts.shape:
            raise ValueError(f"vectors of different lengths: {len(self.low)} and {len(other.low)}")
        n = self.n + other.n
        share = other.n / n
        mean, squares = self.mean + (other.mean - self.mean) * share, self.squares + (other.squares - self.squares) * share
        if self.padded == other.padded and (self.low == other.low).all() and (self.high == other.high).all():
            return Histogram(n, mean, squares, self.low, self.high, self.counts + other.counts, self.padded)
        low, high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        return Histogram(n, mean, squares, low, high, self.over(low, high) + other.over(low, high), False)

    def quantiles(self, q: float) -> np.ndarray:
        """The left edge of the first bin at which the running count reaches q times all."""
        place = [int(np.searchsorted(np.cumsum(c), q * self.n)) for c in self.counts]
        return self.edges[np.arange(len(place)), place]

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqq?", self.n, *self.counts.shape, self.padded)
        return head + zlib.compress(np.concatenate([self.mean, self.squares, self.low, self.high]).astype("<f8").tobytes() + self.counts.astype("<i8").tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Histogram:
        n, dims, bins, padded = struct.unpack_from("<qqq?", data)
        raw = zlib.decompress(data[25:])
        mean, squares, low, high = np.frombuffer(raw, "<f8", 4 * dims).reshape(4, dims)
        return cls(n, mean, squares, low, high, np.frombuffer(raw, "<i8", offset=32 * dims).reshape(dims, bins), padded)


def _bins(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The bin of each value; the last bin has its right edge too, and what rounding puts outside goes to the nearest."""
    return np.clip(np.searchsorted(edges, v, "right") - 1, 0, len(edges) - 2)


def _matrix(column: pa.Array) -> np.ndarray | None:
    """[row][dim] of the vectors that are not null; of [step][dim] columns each step is a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.drop_null()
    if pa.types.is_list(column.type.value_type):
        column = column.flatten().drop_null()
    if not len(column):
        return None
    lengths = np.unique(column.value_lengths().to_numpy())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def states(df: DataFrame, columns: Mapping[str, str], batch: str | None = None, bins: int = BINS) -> DataFrame:
    """field, place (long) and state (binary) of vector or [step][dim] columns (field to column), all in one scan: one for each value of `batch`, an integer
    from 0, or without it one for each partition, whose Arrow batches are merged in order.

    Without `batch` nothing is shuffled, and the result is as fixed as the partitions are."""
    deep = lambda c: df.schema[c].dataType.simpleString().startswith("array<array")
    given = [F.col(c).cast("array<array<double>>" if deep(c) else "array<double>").alias(f"v{i}") for i, c in enumerate(columns.values())]
    rows = df.select(*given, *([F.col(batch).cast("long").alias("place")] if batch else []))
    fields = list(columns)

    def found(held: Mapping[str, Histogram], place: int) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary())
        made = [(f, place, h.to_bytes()) for f, h in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 3, kinds)], ["field", "place", "state"])

    def add(held: dict[str, Histogram], columns: list[pa.Array]) -> None:
        for field, column in zip(fields, columns):
            v = _matrix(column)
            if v is not None:
                new = Histogram.of(v, bins)
                held[field] = held[field].merged(new) if field in held else new

    def of_group(table: pa.Table) -> pa.Table:
        held: dict[str, Histogram] = {}
        add(held, [table.column(i) for i in range(len(fields))])
        return pa.Table.from_batches([found(held, table.column("place")[0].as_py())])

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Histogram] = {}
        for b in batches:
            add(held, b.columns)
        if held:
            yield found(held, TaskContext.get().partitionId())

    return rows.groupBy("place").applyInArrow(of_group, STATE) if batch else rows.mapInArrow(of_partition, STATE)


STATE = "field string, place long, state binary"


def merged(found: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """Each level merges `fan` neighbouring places in order; after enough of them one is left."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        total = None
        for i in order.tolist():
            new = Histogram.from_bytes(table.column("state")[i].as_py())
            total = new if total is None else total.merged(new)
        return pa.table({"field": table.column("field").slice(0, 1), "place": table.column("up").slice(0, 1), "state": pa.array([total.to_bytes()], pa.binary())})

    for _ in range(levels):
        found = found.withColumn("up", F.floor(F.col("place") / fan)).groupBy("field", "up").applyInArrow(run, STATE)
    return found


def statistics(df: DataFrame, vector: str | Mapping[str, str], path: str, batch: str | None = None, quantiles: Sequence[tuple[str, float]] = (("q01", 0.01), ("q99", 0.99)), bins: int = BINS, fan: int = FAN) -> DataFrame:
    """field (where `vector` is a map of fields to columns), dim, n, mean, std, min, max and the named quantiles, in one pass over df. The batches' states are stored at `path`, a new one, in the shared folder.

    Fewer than two vectors are an error; without any the table is empty."""
    spark = df.sparkSession
    columns = {"": vector} if isinstance(vector, str) else vector
    states(df, columns, batch, bins).write.parquet(path)
    found = spark.read.schema(STATE).parquet(path)
    low, high = found.agg(F.min("place"), F.max("place")).first()
    if low is not None and low < 0:
        raise ValueError("batches are numbered from 0")
    levels, places = 0, 1 if high is None else high + 1
    while places > 1 or levels == 0:
        levels, places = levels + 1, -(-places // fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                h = Histogram.from_bytes(data)
                if h.n < 2:
                    raise ValueError("statistics need two vectors at least")
                std = np.sqrt(np.maximum(0, h.squares - h.mean**2))
                columns = [[field] * len(h.low), np.arange(len(h.low), dtype=np.int32), np.full(len(h.low), h.n), h.mean, std, h.low, h.high, *(h.quantiles(q) for _, q in quantiles)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["field", "dim", "n", "mean", "std", "min", "max", *(name for name, _ in quantiles)])

    names = ", ".join(f"{name} double" for name in ("mean", "std", "min", "max", *(name for name, _ in quantiles)))
    out = merged(found, levels, fan).mapInArrow(run, f"field string, dim int, n long, {names}")
    return out.drop("field") if isinstance(vector, str) else out
