"""Toxicity by cumulative-link ordinal regression on sparse text features.

One weight vector w serves all thresholds: P(grade >= k) = 1 / (1 + exp(t_k - w.x)) with t_1 <= t_2. Features are hashed words
and word beginnings, each at three levels: found at least once, twice, four times in the document. The labels are 0 or 1, so
the grades of the training rows are 0 (clean), and for toxic ones 1 or 2, by whether the document shows fewer or more
toxic features than the median toxic one. The score is the expected severity, P(grade >= 1) + P(grade >= 2).

The model is fitted on at most `sample` labelled documents, those with the least hashed ids; at most `features` of the features
that mark toxic documents best (by likelihood ratio) enter it. Scoring reads every document whole.

Defined results: null or empty text has no features and gets the base severity; labels that are null, or rows of labels without a document, are
ignored, and of repeated labels the largest counts; without both kinds of labels nothing is toxic and the severity is 0. A repeated row gets its score again.
Other columns are kept by `annotate`, but for those with a new name, and all by `passing`; `score` does not read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import text as tx
from trajecta.llm.tables import numbered, replaced

LEVELS = (1, 2, 4)
BEGINNINGS = range(4, 10)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights at each level, and the two thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(grade >= 1) and P(grade >= 2) of linear scores."""
        p = 1 / (1 + np.exp(np.clip(self.thresholds[:, None] - x[None, :], -60, 60)))
        return p[0], p[1]


def features(raw: np.ndarray, at: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of all words and word beginnings; with `only`, of those hashes (sorted)."""
    low = tx.LOWER[raw]
    solid = _LETTER[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    document = np.searchsorted(at, start, "right") - 1
    rolling = tx.Rolling(low)
    docs, hashes = [], []
    small = np.zeros(1 << 16, bool)
    if only is not None:
        small[(only & tx.U(0xFFFF)).astype(np.int64)] = True
    for n in (0, *BEGINNINGS):
        if n:
            rows = np.flatnonzero(end - start > n)
            h = rolling.of(start[rows], start[rows] + n) ^ tx.U(0x5851F42D4C957F2D)
        else:
            rows, h = np.arange(len(start)), rolling.of(start, end)
        if only is not None:
            near = small[(h & tx.U(0xFFFF)).astype(np.int64)]
            rows, h = rows[near], h[near]
            if len(only):
                exact = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
                rows, h = rows[exact], h[exact]
        docs.append(document[rows])
        hashes.append(h)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    return d[begin], h[begin], np.diff(np.append(begin, len(d)))


def ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Likelihood-ratio statistic of a feature with the label; negative where the feature marks clean documents."""
    n = n_toxic + n_clean
    total = np.zeros(len(toxic))
    for seen, row, column in ((toxic, toxic + clean, n_toxic), (clean, toxic + clean, n_clean), (n_toxic - toxic, n - toxic - clean, n_toxic), (n_clean - clean, n - toxic - clean, n_clean)):
        part = np.maximum(seen, 1e-12)
        total += np.where(seen > 0, 2 * seen * np.log(part * n / np.maximum(row * column, 1e-12)), 0)
    return np.where(toxic * n_clean > clean * n_toxic, total, -total)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, steps: int = 800, rate: float = 0.05, penalty: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and two thresholds of the cumulative-link model, by full-batch Adam from zero on mean log loss and an L2 penalty."""
    n, m = x.shape
    share = [np.clip((grade >= k).mean(), 1e-4, 1 - 1e-4) for k in (1, 2)]
    first = np.log((1 - share[0]) / share[0])
    gap = max(np.log((1 - share[1]) / share[1]) - first, 1e-2)
    p = np.concatenate([np.zeros(m), [first, np.log(gap)]])
    mean, square = np.zeros(m + 2), np.zeros(m + 2)
    for step in range(1, steps + 1):
        t1, t2 = p[m], p[m] + np.exp(p[m + 1])
        s = x @ p[:m]
        a, b = (1 / (1 + np.exp(np.clip(t - s, -40, 40))) for t in (t1, t2))
        # d log P(grade) / d s for grades 0, 1 and 2, and by each threshold.
        mid = np.maximum(a - b, 1e-9)
        ga = np.where(grade == 0, -a, np.where(grade == 1, a * (1 - a) / mid, 0.0))
        gb = np.where(grade == 1, -b * (1 - b) / mid, np.where(grade == 2, 1 - b, 0.0))
        gradient = np.concatenate([-(x.T @ (ga + gb)) / n + penalty * p[:m], [(ga + gb).mean(), gb.mean() * np.exp(p[m + 1])]])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return p[:m], np.array([p[m], p[m] + np.exp(p[m + 1])])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, features_kept: int = 384, least: int = 3, key: str = "doc_id", column: str = "text", label: str = "toxic") -> Model:
    """The model of at most `sample` labelled documents."""
    spark = docs.sparkSession
    none = Model(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS))), np.array([60.0, 60.0]))
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("y")).orderBy(F.xxhash64(key), key).limit(sample).collect()
    if not chosen:
        return none
    known = F.broadcast(spark.createDataFrame([(int(k), int(y)) for k, y in chosen], "k long, y int"))
    rows = docs.select(F.col(key).alias("k"), F.col(column).alias("text")).join(known, "k").select("k", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each label with each feature at each level, summed in the task; feature 0 at level 0 counts documents."""
        for batch, raw, at in tx.slices(batches, "text"):
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            d, h, n = features(raw, at)
            found = [(np.zeros(len(y), np.uint64), np.zeros(len(y), np.int64), y)]
            found += [(h[n >= v], np.full(int((n >= v).sum()), v), y[d[n >= v]]) for v in LEVELS]
            hs, vs, ys = (np.concatenate(z) for z in zip(*found))
            order = np.lexsort((vs, hs))
            hs, vs, ys = hs[order], vs[order], ys[order]
            new = np.ones(len(hs), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (vs[1:] != vs[:-1])
            begin = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(hs[begin].view(np.int64)), pa.array(vs[begin].astype(np.int32)), pa.array(np.add.reduceat(ys, begin)), pa.array(np.diff(np.append(begin, len(hs))))], ["h", "level", "toxic", "n"])

    counts = rows.mapInArrow(count, "h long, level int, toxic long, n long").groupBy("h", "level").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    counts = counts.where((F.col("toxic") >= least) | (F.col("level") == 0)).where((F.col("level") == 0) | (F.col("toxic") * 2 >= F.col("n")))
    total = counts.where("level = 0").collect()
    if not total or not 0 < total[0].toxic < total[0].n:
        return none
    n_toxic, n_clean = total[0].toxic, total[0].n - total[0].toxic
    strong = F.col("toxic") / n_toxic - (F.col("n") - F.col("toxic")) / n_clean
    # Twenty times as many candidates as are kept, by difference of shares, go over the driver.
    top = counts.where("level > 0").orderBy(strong.desc(), "h", "level").limit(20 * features_kept).collect()
    if not top:
        return none
    h, level, toxic, n = (np.array(z, np.int64) for z in zip(*((r.h, r.level, r.toxic, r.n) for r in top)))
    g = ratio(toxic.astype(float), (n - toxic).astype(float), n_toxic, n_clean)
    order = [i for i in np.lexsort((level, h, -g)) if g[i] > 10.83][:features_kept]
    if not order:
        return none
    hashes = np.unique(h[order].view(np.uint64))
    place = {(x, v): i for i, (x, v) in enumerate(zip(h[order].view(np.uint64).tolist(), level[order].tolist()))}
    known_pairs = np.zeros((len(hashes), len(LEVELS)), np.int64) - 1
    for (x, v), i in place.items():
        known_pairs[np.searchsorted(hashes, np.uint64(x)), LEVELS.index(v)] = i

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in tx.slices(batches, "text"):
            d, hh, nn = features(raw, at, hashes)
            base = np.searchsorted(hashes, hh)
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for j, v in enumerate(LEVELS):
                columns = known_pairs[base, j]
                for i in np.flatnonzero((nn >= v) & (columns >= 0)):
                    lists[d[i]].append(int(columns[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["k", "y", "x"])

    seen = rows.mapInArrow(vectors, "k long, y int, x array<int>").orderBy("k", "x").collect()
    x = np.zeros((len(seen), len(order)), np.float32)
    for i, r in enumerate(seen):
        x[i, r.x] = 1
    y = np.array([r.y for r in seen])
    hits = x.sum(axis=1)
    grade = np.where(y > 0, 1 + (hits > np.median(hits[y > 0])), 0)
    w, thresholds = fit_ordinal(x, grade)
    weights = np.zeros((len(hashes), len(LEVELS)))
    weights[known_pairs >= 0] = w[known_pairs[known_pairs >= 0]]
    return Model(hashes, weights, thresholds)


def _scores(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, h, n = features(raw, at, model.hashes)
    x = np.zeros(len(at) - 1)
    if len(d):
        base = np.searchsorted(model.hashes, h)
        np.add.at(x, d, sum(model.weights[base, j] * (n >= v) for j, v in enumerate(LEVELS)))
    return model.severity(x)


def annotate(docs: DataFrame, model: Model, *, column: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with expected_severity, severity (the grade 0, 1 or 2 that is most likely at least reached) and toxic, which is
    P(grade >= 1) >= threshold. Columns that have these names are replaced."""
    new = ["expected_severity", "severity", "toxic"]
    docs = replaced(docs, new, column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in tx.slices(batches, column):
            p1, p2 = _scores(model, raw, at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p1 + p2), pa.array((p1 >= 0.5).astype(np.int32) + (p2 >= 0.5)), pa.array(p1 >= threshold)], [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, expected_severity double, severity int, toxic boolean")


def passing(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that are not toxic, with exactly their own columns."""
    model = fit(docs, labels, key=key, column=column)
    plain, names = numbered(docs)
    found = annotate(plain, model, column=names[column], threshold=threshold).where("NOT toxic")
    return found.select(*(F.col(new).alias(old) for old, new in names.items()))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", column: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, expected_severity, severity, toxic, kept of every document."""
    found = annotate(docs.select(F.col(key), F.col(column).alias("text")), model, threshold=threshold)
    return found.select(key, "expected_severity", "severity", "toxic", (~F.col("toxic")).alias("kept"))
