"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents with one shingle set are one representative, so copies cost one row each. Bands of `rows` signature values give
buckets; their number follows from the threshold and `miss`, so that a pair at the threshold shares no bucket with a chance below `miss`.
First every member of a bucket meets the bucket's leader, the one with most copies. Then, only in buckets whose other members are
still in different components, all pairs of members of different components meet, in blocks of signatures. A meeting compares
signatures batch by batch and drops the pair once the posterior chance that its similarity reaches the threshold, from a uniform prior, is
below `miss`; survivors are confirmed on their full shingle sets. Links inside a component change nothing and are not
looked for, so no group is expanded into its pairs, and there is no cap on buckets or partners. Components are found by
alternating large-star and small-star steps over stored edge tables.

Defined results: null or blank text has no shingles and is linked with nothing; with fewer words than a shingle, all of them
are one; rows that share a key are one document; a row with a null key is its own component of key null, and kept. Other columns do not matter: `label` does not read them, and `unique`
keeps them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import text as tx
from trajecta.llm.tables import numbered, partitions, stored

BLOCK = 384


@dataclass(frozen=True)
class Settings:
    """Similarity of at least percent / 100 on shingles of `shingle` words; `rows` values to a band; `miss` bounds what is lost."""

    percent: int = 85
    shingle: int = 5
    rows: int = 5
    miss: float = 1e-6
    seed: int = 20_231

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def values(self) -> int:
        return self.rows * self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, matches needed to go on) after each batch of values. With m of n equal, the posterior of the similarity
        is Beta(m + 1, n - m + 1), and its chance to reach t is that of at most m successes in n + 1 trials with chance t."""
        t, out = self.percent / 100, []
        for n in range(25, self.values + 1, 25):
            chance, m = 0.0, -1
            while chance < self.miss:
                m += 1
                chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def shingles(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of all distinct shingles, sorted by both."""
    low = tx.LOWER[raw]
    start, end, words_at = tx.word_bounds(low, at)
    rolling = tx.symbols(tx.Rolling(low).of(start, end))
    words = np.diff(words_at)
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + words_at[doc]
    h = rolling.of(first, first + np.minimum(words, size)[doc])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc, n, s1, s2, sig of every row (doc, text): set size, two hashes of the set, and the MinHash values; null hashes for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(s.seed)
        a, b = rng.integers(0, 1 << 63, (2, s.values), dtype=np.uint64) * tx.U(2) + tx.U(1)
        for rows, raw, at in tx.slices(batches, "text"):
            doc, h = shingles(raw, at, s.shingle)
            n = np.bincount(doc, minlength=rows.num_rows)
            has = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[has]
            sig = np.zeros((len(has), s.values), "<u4")
            sums = np.zeros((2, rows.num_rows), np.uint64)
            if len(has):
                for j in range(s.values):
                    sig[:, j] = np.minimum.reduceat(h * a[j] + b[j], begin) >> tx.U(32)
                sums[0, has] = np.add.reduceat(tx.mix(h), begin)
                sums[1, has] = np.add.reduceat(tx.mix(h ^ tx.U(0xA5A5A5A5A5A5A5A5)), begin)
            empty = n == 0
            values = [None] * rows.num_rows
            for i, r in enumerate(has.tolist()):
                values[r] = sig[i].tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64), mask=empty) for x in sums), pa.array(values, pa.binary())], ["doc", "n", "s1", "s2", "sig"])

    return docs.mapInArrow(run, "doc long, n long, s1 long, s2 long, sig binary")


def _matrix(column: pa.Array, values: int) -> np.ndarray:
    return tx.buffers(column)[0].view("<u4").reshape(-1, values)


def band_hashes(sig: np.ndarray, s: Settings) -> np.ndarray:
    """One hash for each band of each signature; the band's number is part of it."""
    sig = sig.astype(np.uint64)
    h = tx.mix(np.tile(np.arange(s.bands, dtype=np.uint64), (len(sig), 1)))
    for r in range(s.rows):
        h = tx.mix(h * tx.U(0x9FB21C651E98DF25) + sig[:, r :: s.rows])
    return h.view(np.int64)


def buckets(representatives: DataFrame, s: Settings) -> DataFrame:
    """bucket, rep, copies: one row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = band_hashes(_matrix(batch.column(2), s.values), s)
            row = pa.array(np.repeat(np.arange(len(h)), s.bands))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), batch.column(0).take(row), batch.column(1).take(row)], ["bucket", "rep", "copies"])

    return representatives.select("rep", "copies", "sig").mapInArrow(run, "bucket long, rep long, copies long")


def likely(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers of signature pairs that pass every batch."""
    live, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in steps:
        matches = matches + (a[live, done:n] == b[live, done:n]).sum(axis=1)
        keep = matches >= least
        live, matches, done = live[keep], matches[keep], n
        if not len(live):
            break
    return live


def plausible(pairs: DataFrame, representatives: DataFrame, s: Settings) -> DataFrame:
    """The pairs (x, y) whose signatures pass."""
    steps = s.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = likely(_matrix(batch.column(2), s.values), _matrix(batch.column(3), s.values), steps)
                yield batch.select(["x", "y"]).take(pa.array(live))

    sig = representatives.select("rep", "sig")
    both = pairs.join(sig.select(F.col("rep").alias("x"), F.col("sig").alias("sx")), "x").join(sig.select(F.col("rep").alias("y"), F.col("sig").alias("sy")), "y")
    return both.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (x, y) that are similar on their full shingle sets."""
    pairs = stored(pairs.distinct(), "pairs")
    ids = stored(pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct(), "pair-ids")
    texts = stored(docs.join(ids, "doc", "left_semi"), "pair-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in tx.slices(batches, "ty"):
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, first = np.unique(np.concatenate([x, y]), return_index=True)
            both = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first))
            doc, h = shingles(*tx.buffers(both), s.shingle)
            edge = np.searchsorted(doc, np.arange(len(keys) + 1))
            i, j = np.searchsorted(keys, x), np.searchsorted(keys, y)
            similar = np.zeros(len(x), bool)
            for r in range(len(x)):
                p, q = h[edge[i[r]] : edge[i[r] + 1]], h[edge[j[r]] : edge[j[r] + 1]]
                shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) and len(q) else 0
                similar[r] = shared > 0 and 100 * shared >= s.percent * (len(p) + len(q) - shared)
            yield batch.select(["x", "y"]).take(pa.array(np.flatnonzero(similar)))

    of = lambda c: texts.select(F.col("doc").alias(c), F.coalesce("text", F.lit("")).alias(f"t{c}"))
    joined = pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "tx", "ty")
    return joined.mapInArrow(run, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node with an edge (x, y)."""
    pairs = edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, "edges")
    before = None
    while True:
        # Large star: each node sends its greater neighbours to the least of its neighbours and itself.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node sends itself and its smaller neighbours to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = stored(small.distinct(), "edges")
        after = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _blocked(members: DataFrame, representatives: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links (x, y) among members (bucket, rep, component) of one bucket and different components, in blocks of signatures.

    A pair is compared only in the first band that it shares, and only until its components are linked; what passes the signatures is confirmed on the full
    sets at once. So no pair leaves the block but the links that join components."""
    steps = s.least_matches()
    spread = 8 * partitions(members.sparkSession)
    open_buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rows = members.join(open_buckets.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket")
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "open-members")
    ids = stored(rows.select("rep").distinct(), "open-ids")
    texts = docs.join(ids, docs.doc == ids.rep, "left_semi").groupBy("doc").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    data = stored(representatives.select("rep", "sig").join(texts, F.col("rep") == F.col("doc")).select("rep", "sig", "text"), "open-texts")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.col("bucket"), F.lit(spread))).otherwise(F.xxhash64("bucket", "i", "j")))
    rows = rows.join(data, "rep").select("task", "bucket", "i", "j", "block", "rep", "component", "sig", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket, i, j, block, rep, component = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "rep", "component"))
        keys, first, own = np.unique(rep, return_index=True, return_inverse=True)
        chosen = table.take(pa.array(first))
        sig = _matrix(chosen.column("sig"), s.values)
        bands = band_hashes(sig, s)
        doc, h = shingles(*tx.buffers(chosen.column("text")), s.shingle)
        edge = np.searchsorted(doc, np.arange(len(keys) + 1))
        order = np.lexsort((rep, j, i, bucket))
        new = np.flatnonzero(np.append(True, (np.diff(bucket[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)))
        found = []
        for group in np.split(order, new[1:]):
            band = int(np.argmax(bands[own[group[0]]] == bucket[group[0]]))
            label = component[group].copy()
            one = np.flatnonzero(block[group] == i[group[0]])
            two = np.flatnonzero(block[group] == j[group[0]])
            for r in one:
                partners = two[label[two] != label[r]]
                if i[group[0]] == j[group[0]]:
                    partners = partners[partners > r]
                if not len(partners):
                    continue
                a, b = own[group[r]], own[group[partners]]
                live = likely(np.broadcast_to(sig[a], (len(b), s.values)), sig[b], steps)
                if band and len(live):
                    live = live[~(bands[b[live], :band] == bands[a, :band]).any(axis=1)]
                p = h[edge[a] : edge[a + 1]]
                for t in live.tolist():
                    if label[partners[t]] == label[r]:
                        continue
                    q = h[edge[b[t]] : edge[b[t] + 1]]
                    shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    if 100 * shared >= s.percent * (len(p) + len(q) - shared):
                        found.append((keys[a], keys[b[t]]))
                        label[label == label[partners[t]]] = label[r]
        x, y = zip(*found) if found else ((), ())
        return pa.table([pa.array(np.array(x, np.int64)), pa.array(np.array(y, np.int64))], ["x", "y"])

    return rows.groupBy("task").applyInArrow(run, "x long, y long").distinct()


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc, n_shingles, component_id of every row (doc, text)."""
    sets = stored(signatures(docs, s), "signatures")
    keyed = sets.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    groups = keyed.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "sig")).alias("least"), F.count(F.lit(1)).alias("copies"))
    representatives = stored(groups.select(F.col("least.doc").alias("rep"), "copies", F.col("least.sig").alias("sig"), "s1", "s2", "n"), "representatives")
    bands = buckets(representatives, s)
    leaders = bands.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("rep")).alias("minus"))).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(bands.join(leaders.select("bucket", (-F.col("lead.minus")).alias("leader")), "bucket").where("rep <> leader").select("bucket", "rep", "leader"), "members")
    to_leader = members.select(F.col("leader").alias("x"), F.col("rep").alias("y")).distinct()
    edges = stored(confirmed(plausible(to_leader, representatives, s), docs, s), "links")
    first = components(edges)
    placed = members.join(first, members.rep == first.node, "left").select("bucket", "rep", F.coalesce("root", "rep").alias("component"))
    more = stored(_blocked(placed, representatives, docs, s), "links")
    # Rows that share a key are one document whatever their sets.
    shared = representatives.join(keyed.select("doc", "s1", "s2", "n"), ["s1", "s2", "n"]).where("doc <> rep")
    repeated = keyed.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc")
    tied = shared.join(repeated, "doc", "left_semi").select(F.col("rep").alias("x"), F.col("doc").alias("y"))
    final = components(edges.unionByName(more).unionByName(tied))
    reps = representatives.select("s1", "s2", "n", "rep").join(final, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("component_id"))
    return sets.join(reps, ["s1", "s2", "n"], "left").select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def label(docs: DataFrame, s: Settings = Settings(), *, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of every document."""
    found = classes(docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{column}`").alias("text")), s)
    return found.select(F.col("doc").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def unique(docs: DataFrame, s: Settings = Settings(), *, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents that are the least of their component, with all their columns."""
    plain, names = numbered(docs)
    dropped = label(docs, s, key=key, column=column).where("NOT kept").select(F.col(key).alias("_dropped"))
    left = plain.join(dropped, F.col(names[key]) == F.col("_dropped"), "left_anti")
    return left.toDF(*docs.columns)
