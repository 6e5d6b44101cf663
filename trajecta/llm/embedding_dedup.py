"""Near-duplicate vectors of one label, by tiles compared along principal axes.

Rows with the same label and the same vector are one representative. All are turned to the principal axes of their second moments, so that the
first coordinates hold most of a vector's length. Vectors of one label that reach the threshold differ on the first axis by at most
sqrt(2 - 2 * threshold): they lie in the same slab of that width or in neighbouring ones, and a slab is dealt to blocks of bounded size by hash.
Each task gets two blocks. It adds up the products of the leading coordinates step by step; what the rest can add is at most the
product of the two suffix norms (Cauchy and Schwarz), so a tile ends, or goes on for the pairs that are left, once no other can reach the
threshold. What remains is measured again on the vectors as given, in double precision. A task returns for each representative its number of
linked rows and one edge to the least of its group there: a group of near copies gives a row for each member, never its pairs.

Nothing is sampled or capped: the axes come from the moments of all vectors, and only the speed depends on them. Blocks compared with blocks are
quadratic in a slab; that is the method, and it spreads over as many tasks as there are pairs of blocks.

Defined results: a null, zero or empty vector, or one with a null or non-finite component, is linked with nothing, as is any row whose label is null;
vectors of different lengths are not linked. Repeated rows are rows: each counts as a link of the others. Rows that share a key are compared one by
one. A row with a null key counts as a link like any other, and a component is named by its least key that is not null; kept is true where
key and component are equal or both null. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm import tables
from trajecta.llm.minhash_dedup import components
from trajecta.llm.tables import stored

SLACK = 1e-9
MAX_AXES = 2048


@dataclass(frozen=True)
class Settings:
    """Cosine of at least `threshold`; blocks of at most block_bytes, and within a task tiles of `tile` rows."""

    threshold: float = 0.93
    block_bytes: int = 1 << 20
    tile: int = 512

    @property
    def reach(self) -> float:
        """The greatest distance of two unit vectors at the threshold."""
        return math.sqrt(max(0.0, 2 - 2 * self.threshold)) + 1e-6

    def block(self, dim: int) -> int:
        return max(64, self.block_bytes // (8 * dim))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their greatest component first, so that no square leaves the range of doubles."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _matrix(column: pa.Array, dim: int, wide: bool) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), "<f8" if wide else "<f4").reshape(-1, dim)


def usable(rows: DataFrame, wide: bool) -> DataFrame:
    """(key, label, embedding) with dim and vec, the vector's bytes; both null where it cannot be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten()
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = values.to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4")
            end = np.cumsum(size)
            begin = end - size
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            some = np.append(0, np.cumsum(flat != 0))
            good = (bad[end] == bad[begin]) & (some[end] > some[begin])
            data = [flat[b:e].tobytes() if g else None for b, e, g in zip(begin.tolist(), end.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32), mask=~good), pa.array(data, pa.binary())], ["key", "label", "dim", "vec"])

    schema = T.StructType([rows.schema["key"], rows.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def axes(representatives: DataFrame, wide: bool) -> dict[int, np.ndarray]:
    """For the most frequent length (at most MAX_AXES) the principal axes as columns, the longest first. Others keep their own coordinates.

    Each partition sends the sums of its products; the driver gets one matrix."""
    common = representatives.where(F.col("dim") <= MAX_AXES).groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return {}
    dim = common["dim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                v = _unit(_matrix(batch.column(0).slice(at, 4096), dim, wide))
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim, dtype=np.int32), dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), dim)), pa.array(total.ravel())], ["i", "j", "v"])

    sums = representatives.where(F.col("dim") == dim).select("vec").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    moments = np.zeros((dim, dim))
    found = sums.toArrow()
    moments[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    length, direction = np.linalg.eigh((moments + moments.T) / 2)
    return {dim: direction[:, np.argsort(-length)]}


def turned(v: np.ndarray, by: dict[int, np.ndarray]) -> np.ndarray:
    return v @ by[v.shape[1]] if v.shape[1] in by else v


def suffix_norms(v: np.ndarray, at: list[int]) -> np.ndarray:
    """For each step in `at` the lengths of what comes after that many coordinates."""
    squares = np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1]
    return np.stack([np.sqrt(squares[:, k]) if k < v.shape[1] else np.zeros(len(v)) for k in at])


def steps(dim: int) -> list[int]:
    """Numbers of leading coordinates after which a tile is looked at."""
    out, k = [], max(4, dim // 16)
    while k < dim:
        out.append(k)
        k *= 2
    return [*out, dim]


def close(a: np.ndarray, b: np.ndarray, norms_a: np.ndarray, norms_b: np.ndarray, at: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) whose product may reach the threshold, less SLACK. a and b are turned to the axes."""
    i = j = None
    done = 0
    for n, k in enumerate(at):
        if i is None:
            part = a[:, done:k] @ b[:, done:k].T if n == 0 else part + a[:, done:k] @ b[:, done:k].T
            live = part + np.outer(norms_a[n], norms_b[n]) >= threshold - SLACK
            left = np.count_nonzero(live)
            if not left:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if left < live.size / 16 or k == at[-1]:
                i, j = np.nonzero(live)
                part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", a[i, done:k], b[j, done:k])
            live = part + norms_a[n][i] * norms_b[n][j] >= threshold - SLACK
            i, j, part = i[live], j[live], part[live]
            if not len(i):
                break
        done = k
    return i, j


def _least(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the labels of linked rows, in place; each ends as the least row number of its group."""
    while True:
        low = np.minimum(labels[x], labels[y])
        if (low == labels[x]).all() and (low == labels[y]).all():
            return
        for side in (x, y):
            np.minimum.at(labels, labels[side], low)
            np.minimum.at(labels, side, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def compared(blocks: DataFrame, by: dict[int, np.ndarray], wide: bool, s: Settings) -> DataFrame:
    """rep, root, links of every representative with a link in a task: blocks (label, dim, i, a, j, b, first, rep, copies, vec), `first` for block (i, a)."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        rep, copies, first = (table.column(c).to_numpy() for c in ("rep", "copies", "first"))
        given = _unit(_matrix(table.column("vec"), dim, wide))
        order = np.argsort(~first, kind="stable")
        rep, copies, given = rep[order], copies[order], given[order]
        edge = int(first.sum())
        alone = all(table.column(c)[0] == table.column(d)[0] for c, d in (("i", "j"), ("a", "b")))
        at = steps(dim)
        v = turned(given, by)
        norms = suffix_norms(v, at)
        links, labels = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for p in range(0, edge, s.tile):
            pe = min(p + s.tile, edge)
            for q in range(p if alone else edge, len(rep), s.tile):
                qe = min(q + s.tile, len(rep))
                x, y = close(v[p:pe], v[q:qe], norms[:, p:pe], norms[:, q:qe], at, s.threshold)
                if p == q and alone:
                    x, y = x[x < y], y[x < y]
                x, y = x + p, y + q
                sure = np.zeros(len(x), bool)
                for c in range(0, len(x), 1 << 14):
                    sure[c : c + (1 << 14)] = np.einsum("ij,ij->i", given[x[c : c + (1 << 14)]], given[y[c : c + (1 << 14)]]) >= s.threshold
                x, y = x[sure], y[sure]
                if len(x):
                    links += np.bincount(x, copies[y], len(rep)).astype(np.int64) + np.bincount(y, copies[x], len(rep)).astype(np.int64)
                    _least(labels, x, y)
        has = links > 0
        return pa.table([pa.array(rep[has]), pa.array(rep[labels[has]]), pa.array(links[has])], ["rep", "root", "links"])

    return blocks.groupBy("label", "dim", "i", "a", "j", "b").applyInArrow(run, "rep long, root long, links long")


def placed(representatives: DataFrame, by: dict[int, np.ndarray], wide: bool, s: Settings) -> DataFrame:
    """representatives with slab, the number of the interval of width `reach` on the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            vec = batch.column(batch.schema.get_field_index("vec"))
            slab = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                axis = by[dim][:, 0] if dim in by else np.eye(dim)[0]
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    slab[some] = np.floor(_unit(_matrix(vec.take(pa.array(some)), dim, wide)) @ axis / s.reach)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab)], [*batch.schema.names, "slab"])

    return representatives.mapInArrow(run, T.StructType([*representatives.schema.fields, T.StructField("slab", T.IntegerType())]))


def paired(rows: DataFrame, s: Settings) -> DataFrame:
    """Every representative once for each pair of blocks that its block is in."""
    sizes = rows.groupBy("label", "dim", "slab").agg(F.count(F.lit(1)).alias("n"))
    block = F.greatest(F.lit(64), F.floor(F.lit(s.block_bytes) / (8 * F.col("dim")))).cast("int")
    sizes = stored(sizes.select("label", "dim", "slab", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "slabs")
    near = sizes.select("label", "dim", F.explode(F.array(F.col("slab") - 1, "slab", F.col("slab") + 1)).alias("slab"), F.col("slab").alias("other"), "blocks")
    own = near.where("slab = other").withColumnRenamed("blocks", "mine").drop("other")
    near = near.join(own, ["label", "dim", "slab"])
    both = rows.join(near, ["label", "dim", "slab"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("mine")).cast("int"))
    both = both.withColumn("there", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here, away = F.struct(F.col("slab").alias("s"), F.col("block").alias("b")), F.struct(F.col("other").alias("s"), F.col("there").alias("b"))
    both = both.withColumns({"low": F.least(here, away), "high": F.greatest(here, away), "first": here <= away})
    return both.select("label", "dim", F.col("low.s").alias("i"), F.col("low.b").alias("a"), F.col("high.s").alias("j"), F.col("high.b").alias("b"), "first", "rep", "copies", "vec")


def label(vectors: DataFrame, s: Settings = Settings(), *, key: str = "vec_id", column: str = "embedding", group: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    element = vectors.schema[column].dataType.elementType
    wide = not isinstance(element, T.FloatType)
    source = F.col(f"`{column}`").cast("array<double>") if wide else F.col(f"`{column}`")
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("label"), source.alias("embedding"))
    rows = stored(usable(rows, wide), "vectors")
    linkable = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull())
    groups = linkable.groupBy("label", "dim", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("low"))
    representatives = stored(groups.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    by = axes(representatives, wide)
    near = stored(placed(representatives.select("label", "dim", "rep", "copies", "vec"), by, wide, s), "placed")
    found = stored(compared(paired(near, s), by, wide, s), "tiles")
    roots = components(found.select(F.col("rep").alias("x"), F.col("root").alias("y")))
    least = roots.join(representatives.select(F.col("rep").alias("node"), "low"), "node")
    names = least.join(least.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "component")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = representatives.join(counts, "rep", "left").join(names, F.col("rep") == F.col("node"), "left")
    facts = facts.select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component"), F.lit(True).alias("hit"))
    facts = stored(facts.where("n_links > 0"), "linked-vectors")
    out = rows.join(facts, ["label", "dim", "vec"], "left")
    component = F.when(F.col("hit"), F.col("component")).otherwise(F.col("key"))
    out = out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    out = out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    tables.drop(near, found, representatives)
    return out


def unique(vectors: DataFrame, s: Settings = Settings(), *, key: str = "vec_id", column: str = "embedding", group: str = "label") -> DataFrame:
    """The vectors that are the least of their component, with all their columns. Keys are unique here; rows with a null key stay."""
    plain, names = tables.numbered(vectors)
    dropped = label(vectors, s, key=key, column=column, group=group).where("NOT kept").select(F.col(key).alias("_dropped"))
    return plain.join(dropped, F.col(names[key]) == F.col("_dropped"), "left_anti").toDF(*vectors.columns)
