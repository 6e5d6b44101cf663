"""Codebooks: the nearest code of a vector, the vector of a code, and actions from codes, with zeros where they cannot be read.

A codebook goes to every task with its function, so its size is bounded by MAX_BYTES; a larger one is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.functions import text, vector

MAX_BYTES = 64 << 20
BLOCK = 4096


def bins(kind: str, size: int) -> tuple[int, ...]:
    """Levels of each dimension for a codebook of about `size` codes: the published table ("fsq"), two equal dimensions ("custom"), or two levels in each ("lfq")."""
    if kind == "lfq":
        if size < 2 or size & size - 1:
            raise ValueError("a codebook of this kind has a power of two codes")
        return (2,) * (size.bit_length() - 1)
    if size not in vector.FSQ_BINS.get(kind, {}):
        raise ValueError(f"no codebook of kind {kind} and size {size}")
    return vector.FSQ_BINS[kind][size]


def declared_size(size: int) -> int:
    """The vocabulary that a tokeniser declares for a target size: that of the published table, whatever kind its codebook is."""
    return int(np.prod(bins("fsq", size)))


def grid(levels: Sequence[int]) -> np.ndarray:
    """All codes of a codebook of levels as vectors in [-1, 1], code 0 first; the first dimension changes fastest."""
    codes, out, place = np.arange(int(np.prod(levels))), [], 1
    for b in levels:
        out.append(codes // place % b / (b - 1) * 2.0 - 1.0)
        place *= b
    return np.stack(out, axis=1)


def _checked(codes: np.ndarray) -> np.ndarray:
    codes = np.ascontiguousarray(codes, np.float64)
    if codes.ndim != 2 or not len(codes) or not np.isfinite(codes).all():
        raise ValueError("a codebook is a table of finite vectors")
    if codes.nbytes > MAX_BYTES:
        raise ValueError(f"a codebook of {codes.nbytes} bytes is too large for every task to hold")
    return codes


def nearest(df: DataFrame, column: str, codes: np.ndarray, code: str = "code", distance: str = "distance") -> DataFrame:
    """df with the number of the nearest code of a vector and its distance; of equals the least. Null for a null vector and for one with a null or NaN.

    Another length than the codebook's is an error. Vectors meet the codebook in blocks, by one matrix product each; the three nearest by that are measured again directly."""
    codes = _checked(codes)
    lengths = (codes * codes).sum(axis=1)

    def found(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.argsort(lengths - 2.0 * (v @ codes.T), axis=1, kind="stable")[:, :3]
        near.sort(axis=1)
        exact = np.sqrt(((v[:, None, :] - codes[near]) ** 2).sum(axis=2))
        best = exact.argmin(axis=1)
        rows = np.arange(len(v))
        return near[rows, best], exact[rows, best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths()
            if any(n not in (None, codes.shape[1]) for n in size.unique().to_pylist()):
                raise ValueError(f"the codebook's vectors have {codes.shape[1]} elements, not {size.unique().to_pylist()}")
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, codes.shape[1])
            good = np.flatnonzero(there)[np.isfinite(flat).all(axis=1)]
            v = flat[np.isfinite(flat).all(axis=1)]
            number, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at in range(0, len(v), BLOCK):
                number[good[at : at + BLOCK]], far[good[at : at + BLOCK]] = found(v[at : at + BLOCK])
            lost = np.ones(batch.num_rows, bool)
            lost[good] = False
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(number, mask=lost), pa.array(far, mask=lost)], ["row", "code", "distance"])

    kept = [c for c in df.columns if c not in (code, distance)]
    rows = df.select(F.col(column).cast("array<double>").alias("v"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("code", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("row.*", F.col("code").alias(code), F.col("distance").alias(distance))


def vectors(df: DataFrame, column: str, codes: np.ndarray, out: str = "vectors") -> DataFrame:
    """df with the vectors of an array of codes, one after another in one array; null if the array is null or any code is null or not in the codebook."""
    codes = _checked(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            bad = (flat < 0) | (flat >= len(codes))
            end = np.cumsum(size)
            wrong = np.append(0, np.cumsum(bad))
            lost = ~lists.is_valid().to_numpy(zero_copy_only=False) | (wrong[end] > wrong[end - size])
            values = codes[np.where(bad, 0, flat)].ravel()
            offsets = np.append(0, end * codes.shape[1])
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            made = pa.array([None if x else y for x, y in zip(lost.tolist(), made.to_pylist())], pa.list_(pa.float64())) if lost.any() else made
            yield pa.RecordBatch.from_arrays([batch.column(1), made], ["row", "v"])

    kept = [c for c in df.columns if c != out]
    rows = df.select(F.col(column).cast("array<long>").alias("c"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("v", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).select("row.*", F.col("v").alias(out))


def actions(df: DataFrame, tokens: str, codes: np.ndarray, vocabulary: int, horizon: int, dim: int, out: str = "actions", encode: Callable[[Column], Column] = text.characters) -> DataFrame:
    """df with [horizon][dim] actions of a model's tokens: the codes between `Action: ` and the next bar, their vectors one after another, cut to horizon * dim.

    Any fault gives zeros: no marker, a code outside the codebook, too few values, null tokens. The codebook stands in for a trained decoder."""
    coded = df.withColumn("_codes", text.action_tokens(F.col(tokens), vocabulary, encode))
    made = vectors(coded, "_codes", codes, "_values")
    rows = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.slice("_values", k * dim + 1, F.lit(dim)))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), dim), horizon)
    return made.withColumn(out, F.when(F.coalesce(F.size("_values"), F.lit(-1)) >= horizon * dim, rows).otherwise(zeros)).drop("_codes", "_values")
