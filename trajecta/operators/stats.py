"""Mergeable statistics of vector columns, and their JSON form.

Mean, deviation and extremes are one partial and one final aggregate over (dimension). Quantiles are the left edges of equal
bins between the global extremes, in two passes: the result is the same for any partitioning and batch order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 5000


def elements(df: DataFrame, vector: Column, field: str) -> DataFrame:
    """field, dim, v: one row for each element."""
    return df.select(F.lit(field).alias("field"), F.posexplode(vector).alias("dim", "v"))


def chunk_elements(df: DataFrame, chunks: Column, field: str) -> DataFrame:
    """The same for [step][dim] columns: every step counts."""
    return df.select(F.explode(chunks).alias("_step")).select(F.lit(field).alias("field"), F.posexplode("_step").alias("dim", "v"))


def moments(long: DataFrame) -> DataFrame:
    """field, dim, n, mean, std (population), min, max; fewer than two values are an error where std is read, here a null."""
    v = F.col("v")
    spread = F.when(F.count(v) >= 2, F.stddev_pop(v))
    return long.groupBy("field", "dim").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), spread.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def histogram(long: DataFrame, extremes: DataFrame, bins: int = BINS) -> DataFrame:
    """field, dim, bin, n, min, width over equal bins; the greatest value is in the last. At most bins rows to a dimension are shuffled."""
    edges = extremes.select("field", "dim", F.col("min").alias("low"), ((F.col("max") - F.col("min")) / bins).alias("width"))
    # One row for each element of the vectors, whatever the number of rows.
    placed = long.where(F.col("v").isNotNull()).join(F.broadcast(edges), ["field", "dim"])
    number = F.when(F.col("width") > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / F.col("width")))).otherwise(0)
    return placed.withColumn("bin", number.cast("int")).groupBy("field", "dim", "bin", "low", "width").agg(F.count(F.lit(1)).alias("n"))


def histogram_quantiles(long: DataFrame, quantiles: dict[str, float], bins: int = BINS) -> DataFrame:
    """field, dim and the named quantiles: the left edge of the first bin whose running count reaches q times all."""
    counts = histogram(long, moments(long), bins)
    window = Window.partitionBy("field", "dim")
    running = counts.withColumns({"_run": F.sum("n").over(window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(window)})
    edge = F.col("low") + F.col("bin") * F.col("width")
    return running.groupBy("field", "dim").agg(*(F.min(F.when(F.col("_run") >= q * F.col("_all"), edge)).alias(name) for name, q in quantiles.items()))


def norm_stats(long: DataFrame, bins: int = BINS) -> DataFrame:
    """field, and mean, std, q01 and q99 as vectors."""
    both = moments(long).join(histogram_quantiles(long, {"q01": 0.01, "q99": 0.99}, bins), ["field", "dim"])
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "q01", "q99")))
    return both.groupBy("field").agg(rows.alias("_rows")).select("field", *(F.col("_rows")[c].alias(c) for c in ("mean", "std", "q01", "q99")))


@dataclass(frozen=True)
class NormStats:
    mean: list[float]
    std: list[float]
    q01: list[float] | None = None
    q99: list[float] | None = None


def collected(stats: DataFrame) -> dict[str, NormStats]:
    """One row for each field goes to the driver."""
    return {r["field"]: NormStats(r["mean"], r["std"], r["q01"], r["q99"]) for r in stats.collect()}


def to_json(stats: dict[str, NormStats]) -> str:
    return json.dumps({"norm_stats": {k: vars(v) for k, v in stats.items()}}, indent=2)


def from_json(text: str) -> dict[str, NormStats]:
    return {k: NormStats(**v) for k, v in json.loads(text)["norm_stats"].items()}
