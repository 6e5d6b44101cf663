"""Best-fit decreasing packing of token pieces into sequences.

The classic algorithm takes the pieces from longest to shortest and puts each in the fullest sequence that still has room, found
in logarithmic time in a segment tree over remaining capacities. Its choices depend on lengths alone, so it runs here on the
counts of pieces of each length, at most `capacity` numbers whatever the corpus: pieces of one length that go to sequences
with one history are placed together. The plan, intervals of a piece's rank among its length, is then joined to the pieces.
The result is that of best-fit decreasing over all pieces of the corpus.

Defined results: null and empty text are the end id alone, one piece of length 1; a text of up to `capacity` ids is one piece;
a longer one is cut into pieces of `capacity`, of which the first may be shorter; repeated rows are packed each on its own. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajecta.llm import text as tx
from trajecta.llm import tokens
from trajecta.llm.tables import stored


class CapacityTree:
    """Segment tree over capacities 0..n: how many open sequences have each, and the least capacity from a bound on that some have."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The least capacity >= `least` with an open sequence."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Run:
    """Sequences first..first+count-1, alike so far."""

    first: int
    count: int


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts of lengths: rows (length, first rank, last rank, first sequence, pieces to a sequence, offset).

    A piece of that length and rank r goes to sequence first + (r - first rank) // pieces, at
    offset + length * ((r - first rank) % pieces)."""
    tree = CapacityTree(capacity)
    open_runs: dict[int, list[Run]] = {}
    rows, sequences = [], 0

    def put(room: int, run: Run) -> None:
        if room:
            open_runs.setdefault(room, []).append(run)
            tree.add(room, run.count)

    for length in sorted(lengths, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit in {capacity}")
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # New sequences, filled one after another as each stays the tightest until it is full.
                room, each = capacity, capacity // length
                run = Run(sequences, -(-left // each))
                sequences += run.count
            else:
                each = room // length
                run = open_runs[room].pop()
                tree.add(room, -run.count)
            whole = min(run.count, left // each)
            if whole:
                rows.append((length, rank, rank + whole * each - 1, run.first, each, capacity - room))
                put(room - length * each, Run(run.first, whole))
                rank, left = rank + whole * each, left - whole * each
                run = Run(run.first + whole, run.count - whole)
            if run.count and left and left < each:
                rows.append((length, rank, rank + left - 1, run.first, left, capacity - room))
                put(room - length * left, Run(run.first, 1))
                rank, left = rank + left, 0
                run = Run(run.first + 1, run.count - 1)
            if run.count:
                put(room, run)
    return rows



def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of every document, and part, rank: the piece's number of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.loaded(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for rows, raw, at in tx.slices(batches, column, tokens.SLICE_BYTES):
            flat, edge = encoder.encode(raw, at)
            ids = [flat[a:b].tobytes() + end for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            size = np.diff(edge) + 1
            number = -(-size // capacity)
            row = np.repeat(np.arange(len(ids)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            first = size - (number - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            crc = [zlib.crc32(memoryview(ids[r])[4 * s : 4 * (s + n)]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            new = np.concatenate([[True], sorted_length[1:] != sorted_length[:-1]])
            begin = np.flatnonzero(new)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) + seen[sorted_length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)],
                [key, "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return docs.select(F.col(key), F.col(column).alias(column)).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: all documents packed.

    Only the counts of lengths (at most `capacity` rows) go over the driver, and the plan goes to the tasks; it has few intervals to a
    length, of a number that depends on `capacity` alone. Pieces meet the counts of the tasks before theirs, at most `capacity` numbers, by their write task."""
    cut = stored(pieces(docs, path, end_id, capacity, key, column), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("length", "part", "n", before.alias("before")), "piece-counts")
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    steps: dict[int, list] = {}
    for length, low, _, first, each, offset in plan(lengths, capacity):
        steps.setdefault(length, []).append((low, first, each, offset))
    table = {n: tuple(np.array(x, np.int64) for x in zip(*steps[n])) for n in steps}
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(task: pa.Table, earlier: pa.Table) -> pa.Table:
        length, rank = (task.column(c).to_numpy() for c in ("length", "rank"))
        base = np.zeros(capacity + 1, np.int64)
        base[earlier.column("length").to_numpy()] = earlier.column("before").to_numpy()
        rank = rank + base[length]
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for block in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[block[0]])
            low, first, each, begin = table[n]
            i = np.searchsorted(low, rank[block], "right") - 1
            step = rank[block] - low[i]
            sequence[block] = first[i] + step // each[i]
            offset[block] = begin[i] + n * (step % each[i])
        return pa.table([*(task.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cut.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(place, schema)
