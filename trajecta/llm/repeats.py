"""Candidate search, sharding and assembly shared by the two repeat removers.

A window is `size` consecutive symbols (bytes or words) of one document. Each window has one anchor: of its grams of `gram` symbols, the one
with the least hash, the first of equals. Equal windows have equal anchors at equal places in them, so only windows whose anchors have
equal hashes need comparing. The windows of one anchor are consecutive; the stretch of text that they cover is the anchor's context.

1. `anchored`: every document is cut into anchors. Of the places of one anchor in a slice, only the first goes to the anchor's bucket; where there
   are several, the others are open at once. So a bucket has at most one entry for each slice and anchor.
2. `opened`: an anchor with one place in all documents is done with; all places of the others are open.
3. The texts of all open contexts go to shards by anchor; contexts with the same bytes are one string with several places. In a shard the suffix
   structure named by the operator decides which windows of these strings have an equal one that starts earlier. Anchors with more than `hot` places are first dealt to shards of at
   most about `hot` of their contexts; what is not removed there meets in one shard. Hashes choose what meets and decide nothing.
4. The removed stretches of a document are united and applied to its whole text.

Order is (key, start). Rows with one key and one text are one document: each gets its result and they do not remove one another. Rows with
one key and different texts are different documents, ordered by the hash of their texts. A row with a null key has no place in the order: it is neither
compared nor changed. Null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import text as tx
from trajecta.llm.tables import drop, partitions, stored

ANCHOR = np.dtype([("hash", np.int64), ("doc", np.int64), ("version", np.int64), ("low", np.int32), ("size", np.int32)])
CONTEXT = np.dtype([("doc", np.int64), ("version", np.int64), ("low", np.int32)])
PLACE = (1 << 31) - 1
POINT = 0x5DEECE66D1CE4E5B
NO_KEY = -(1 << 63)
# Columns of its own, which an input may not have; `remove` replaces them.
OWN = ("_doc", "_version", "_of", "_of_version", "_spans", "open")


@dataclass(frozen=True)
class Unit:
    """How text becomes symbols: for a slice's bytes and offsets, symbols with offsets, and each symbol's first and last byte. `exact` gives
    symbols that are equal only if their bytes are, `bounds` all but the symbols."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    exact: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bounds: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    size: int
    gram: int


def as_bytes(raw: np.ndarray, at: np.ndarray):
    place = np.arange(len(raw))
    return raw, at, place, place + 1


def byte_bounds(raw: np.ndarray, at: np.ndarray):
    return as_bytes(raw, at)[1:]


def word_bounds(raw: np.ndarray, at: np.ndarray):
    start, end, words_at = tx.word_bounds(raw, at)
    return words_at, start, end


def as_words(raw: np.ndarray, at: np.ndarray):
    """Words as 64-bit hashes."""
    start, end, words_at = tx.word_bounds(raw, at)
    return tx.Rolling(raw).of(start, end), words_at, start, end


def as_word_numbers(raw: np.ndarray, at: np.ndarray):
    """Words as their numbers in order of first use."""
    start, end, words_at = tx.word_bounds(raw, at)
    data, numbers = raw.tobytes(), {}
    codes = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(start.tolist(), end.tolist())]
    return np.array(codes, np.int64), words_at, start, end


def identified(docs: DataFrame, key: str, column: str) -> DataFrame:
    """docs with _doc and _version, which tell documents apart and order them; neither is ever null, and a null key has a version that no other has."""
    of = F.col(f"`{key}`").cast("long")
    return docs.select("*", F.coalesce(of, F.lit(NO_KEY)).alias("_doc"), F.xxhash64(F.col(f"`{column}`"), of.isNull()).alias("_version"))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each place, a polynomial modulo 2**64 built by doubling. It only chooses which contexts meet, so grams that collide cost
    time and nothing else."""
    one = symbols.astype(np.uint64) + tx.U(1)
    h, have = one, 1
    for bit in f"{gram:b}"[1:]:
        h = h[:-have] * tx.U(pow(POINT, have, 1 << 64)) + h[have:]
        have *= 2
        if bit == "1":
            h = h[:-1] * tx.U(POINT) + one[have:]
            have += 1
    return tx.mix(h)


def anchors(symbols: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor: its document, hash, and first and last window."""
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(at) - size + 1, 0)
    if not count.sum():
        return none, none, none, none
    grams = gram_hashes(symbols, gram)
    least = (grams & ~tx.U(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width, have = size - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    doc = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + at[doc]
    chosen = (least[window] & tx.U(PLACE)).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    first, last = window[begin], window[np.append(begin[1:], len(doc)) - 1]
    return doc[begin], grams[chosen[begin]].view(np.int64), first, last


def _packed(records: np.ndarray, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each bucket, its records in one binary value."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    edge = (np.append(begin, len(bucket)) * records.itemsize).astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array(np.full(len(begin), kind, np.int32)), payload], ["bucket", "kind", "payload"])


def anchored(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """bucket, kind, payload: of the anchors of all documents (_doc, _version, text) in a slice, those alone there (kind 0), the first of several
    (kind 1), and the others (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, "text"):
            keys, versions = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            symbols, symbols_at, _, _ = unit.symbols(raw, at)
            doc, h, first, last = anchors(symbols, symbols_at, unit.size, unit.gram)
            a = np.empty(len(doc), ANCHOR)
            a["hash"], a["doc"], a["version"] = h, keys[doc], versions[doc]
            a["low"], a["size"] = first - symbols_at[doc], last - first + unit.size
            a = a[np.argsort(h)]
            new = np.append(True, a["hash"][1:] != a["hash"][:-1])[: len(a)]
            alone = new & np.append(new[1:], True)[: len(a)]
            for kind, chosen in enumerate((alone, new & ~alone, ~new)):
                yield _packed(a[chosen], (a["doc" if kind == 2 else "hash"][chosen].view(np.uint64) % tx.U(buckets)).astype(np.int64), kind)

    return docs.mapInArrow(run, "bucket int, kind int, payload binary")


def opened(packed: DataFrame) -> DataFrame:
    """_doc, _version, low, high, hash of all open contexts."""

    def run(table: pa.Table) -> pa.Table:
        kind, payload = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        one, first, others = (np.frombuffer(b"".join(p for k, p in zip(kind, payload) if k == n), ANCHOR) for n in range(3))
        a, several = np.concatenate([one, first]), np.arange(len(one) + len(first)) >= len(one)
        order = np.argsort(a["hash"], kind="stable")
        a, several = a[order], several[order]
        same = a["hash"][1:] == a["hash"][:-1]
        a = a[several | np.append(False, same)[: len(a)] | np.append(same, False)[: len(a)]]
        a = np.concatenate([a, others])
        return pa.table([pa.array(x) for x in (a["doc"], a["version"], a["low"], a["low"] + a["size"], a["hash"])], ["_doc", "_version", "low", "high", "hash"])

    return packed.groupBy("bucket").applyInArrow(run, "_doc long, _version long, low int, high int, hash long")


def contexts(docs: DataFrame, wanted: DataFrame, unit: Unit, column: str) -> DataFrame:
    """shard, hash, again, places, text: the texts of all open contexts, each with its places (packed) in a slice.
    wanted: _doc, _version, open (low, high, hash, shard, again)."""
    names = ["shard", "hash", "again", "places", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, column):
            symbols_at, start, end = unit.bounds(raw, at)
            lists = rows.column(rows.num_columns - 1)
            row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
            low, high, h, shard, again = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
            a, b = start[symbols_at[row] + low], end[symbols_at[row] + high - 1]
            place = np.empty(len(row), CONTEXT)
            place["doc"], place["version"], place["low"] = (rows.column(rows.schema.get_field_index("_doc")).to_numpy()[row], rows.column(rows.schema.get_field_index("_version")).to_numpy()[row], low)
            data, alike = raw.tobytes(), {}
            for i, x, y, of in zip(range(len(row)), a.tolist(), b.tolist(), shard.tolist()):
                alike.setdefault((of, data[x:y]), []).append(i)
            first = np.array([i[0] for i in alike.values()], np.int64)
            packed = [place[i].tobytes() for i in alike.values()]
            found = [pa.array(shard[first]), pa.array(h[first]), pa.array(again[first].astype(bool)), pa.array(packed, pa.binary()), pa.array([t for _, t in alike], pa.binary())]
            found = pa.RecordBatch.from_arrays(found, names)
            yield from (found.slice(i, 4096) for i in range(0, found.num_rows, 4096))

    # All columns go through, so that the planner shuffles the documents once for this join and the last one.
    joined = docs.join(wanted.withColumnsRenamed({"_doc": "_of", "_version": "_of_version"}), (F.col("_doc") == F.col("_of")) & (F.col("_version") == F.col("_of_version")))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), "open").mapInArrow(run, "shard int, hash long, again boolean, places binary, text binary")


def _groups(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the groups of n things, of which breaks[i] parts i + 1 from i."""
    begin = np.flatnonzero(np.append(True, breaks))[:n]
    return begin, np.append(begin[1:], n)[: len(begin)]


def repeated_windows(shard: pa.Table, unit: Unit, later: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """_doc, _version, low, high, hash, places, text: the stretches of a shard's windows that also start earlier (without the last three), and of contexts to be
    compared again the stretches of their other windows.

    Each different context enters the structure once, in order of its first place. later(symbols, at) gives the places in the contexts at
    which a window starts that has an equal one before it; at the other places of a context all windows do."""
    numbers: dict[bytes, int] = {}
    texts = shard.column("text").to_pylist()
    of_row = np.array([numbers.setdefault(t, len(numbers)) for t in texts], np.int64)
    packed = shard.column("places").to_pylist()
    place = np.frombuffer(b"".join(packed), CONTEXT)
    text = np.repeat(of_row, [len(p) // CONTEXT.itemsize for p in packed]) if len(packed) else of_row
    order = np.lexsort((place["low"], place["version"], place["doc"]))
    place, text = place[order], text[order]
    new = np.append(True, place[1:] != place[:-1])[: len(place)]
    place, text = place[new], text[new]
    first = np.unique(text, return_index=True)[1]
    by_place = np.argsort(first)
    h, again = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    h[of_row], again[of_row] = shard.column("hash").to_numpy(), shard.column("again").to_numpy().astype(bool)
    known = [*numbers]
    raw, at = tx.buffers(pa.array([known[i] for i in by_place.tolist()], pa.large_binary()))
    symbols, symbols_at, start, end = unit.exact(raw, at)
    gone = np.zeros(len(symbols) + 1, bool)
    gone[later(symbols, symbols_at)] = True
    places = np.flatnonzero(gone)
    row = np.searchsorted(symbols_at, places, "right") - 1
    begin, stop = _groups((np.diff(places) > unit.size) | (np.diff(row) > 0), len(places))
    a, b, row = places[begin], places[stop - 1] + unit.size, row[begin]
    own, low = place[first[by_place]], place[first[by_place]]["low"].astype(np.int64)
    copies = np.ones(len(place), bool)
    copies[first] = False
    length = np.zeros(len(first), np.int64)
    length[by_place] = np.diff(symbols_at)
    spans = [(own[row], low[row] + a - symbols_at[row], b - a), (place[copies], place["low"][copies].astype(np.int64), length[text[copies]])]
    hashes, left_places, left_texts = [None] * sum(len(x[0]) for x in spans), [], []
    if again.any():
        count = np.maximum(np.diff(symbols_at) - unit.size + 1, 0) * again[by_place]
        window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(symbols_at[:-1], count)
        left = window[~gone[window]]
        owner = np.searchsorted(symbols_at, left, "right") - 1
        begin, stop = _groups((np.diff(left) > 1) | (np.diff(owner) > 0), len(left))
        a, b, row = left[begin], left[stop - 1] + unit.size, owner[begin]
        rest = own[row].copy()
        rest["low"] = low[row] + a - symbols_at[row]
        spans.append((rest, rest["low"].astype(np.int64), b - a))
        hashes += h[by_place][row].tolist()
        data = raw.tobytes()
        left_places, left_texts = [x.tobytes() for x in rest], [data[x:y] for x, y in zip(start[a].tolist(), end[b - 1].tolist())]
    owners, lows, sizes = (np.concatenate(x) for x in zip(*spans))
    blank = [None] * (len(hashes) - len(left_texts))
    columns = [pa.array(owners["doc"]), pa.array(owners["version"]), pa.array(lows.astype(np.int32)), pa.array((lows + sizes).astype(np.int32)), pa.array(hashes, pa.int64())]
    return pa.table([*columns, pa.array(blank + left_places, pa.binary()), pa.array(blank + left_texts, pa.binary())], ["_doc", "_version", "low", "high", "hash", "places", "text"])


def removed_spans(docs: DataFrame, key: str, column: str, unit: Unit, later: Callable[[np.ndarray, np.ndarray], np.ndarray], *, shard_bytes: int = 2 << 20, hot: int = 8192, broadcast: int = 1_000_000) -> DataFrame:
    """_of, _of_version, _spans array<struct<low, high>>: for each document of `identified` with removed symbols, their stretches, not united."""
    spark = docs.sparkSession
    only = docs.where(F.col(f"`{key}`").isNotNull()).select("_doc", "_version", F.col(f"`{column}`").alias("text"))
    # A bucket is a sixteenth of a task's share, so that groupBy holds little at once.
    found = stored(opened(anchored(only, unit, 16 * partitions(spark))), "anchors")
    width = 1 if unit.exact is as_bytes else 8
    total = found.agg(F.sum(F.col("high") - F.col("low"))).first()[0] or 0
    shards = max(partitions(spark), -(-total * width // shard_bytes))
    counted = stored(found.groupBy(F.col("hash").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot-anchors")
    large = F.broadcast(counted) if counted.count() <= broadcast else counted  # at most 16 MB
    parts = F.coalesce(F.ceil(F.col("n") / hot), F.lit(1))
    dealt = found.join(large, F.col("hash") == F.col("of"), "left").withColumn("shard", F.pmod(F.xxhash64("hash", F.pmod(F.xxhash64("_doc", "_version"), parts)), F.lit(shards)).cast("int"))
    wanted = dealt.groupBy("_doc", "_version").agg(F.collect_list(F.struct("low", "high", "hash", "shard", F.col("n").isNotNull().alias("again"))).alias("open"))
    schema = "_doc long, _version long, low int, high int, hash long, places binary, text binary"
    first = stored(contexts(docs, wanted, unit, column).groupBy("shard").applyInArrow(lambda shard: repeated_windows(shard, unit, later), schema), "windows")
    drop(found, counted)
    left = first.where("hash IS NOT NULL").select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), "hash", F.lit(False).alias("again"), "places", "text")
    second = left.groupBy("shard").applyInArrow(lambda shard: repeated_windows(shard, unit, later), schema)
    spans = first.where("hash IS NULL").select("_doc", "_version", "low", "high").unionByName(second.select("_doc", "_version", "low", "high"))
    return spans.groupBy(F.col("_doc").alias("_of"), F.col("_version").alias("_of_version")).agg(F.collect_list(F.struct("low", "high")).alias("_spans"))


def applied(docs: DataFrame, spans: DataFrame, names: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The columns `names` of the documents of `identified` with their spans as the last column, through `run`."""
    joined = docs.join(spans, (F.col("_doc") == F.col("_of")) & (F.col("_version") == F.col("_of_version")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in names), "_spans").mapInArrow(run, schema)


def keep_masks(rows: pa.RecordBatch, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """For each row its number, which of its symbols stay, and the number of removed stretches."""
    lists = rows.column(rows.schema.get_field_index("_spans")).to_pylist()
    for i, spans in enumerate(lists):
        n = int(at[i + 1] - at[i])
        if not spans:
            yield i, np.ones(n, bool), 0
            continue
        step = np.zeros(n + 1, np.int32)
        for s in spans:
            step[min(s["low"], n)] += 1
            step[min(s["high"], n)] -= 1
        gone = np.cumsum(step[:-1]) > 0
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        yield i, ~gone, runs

