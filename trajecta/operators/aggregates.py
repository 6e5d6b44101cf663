"""Summaries of timings, evaluations, training metrics and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERCENTILES = (25, 50, 75, 90, 95, 99)


def timing_summary(long: DataFrame, key: str = "key", value: str = "ms") -> DataFrame:
    """Mean, population deviation and interpolated percentiles of each key."""
    found = F.percentile(value, [p / 100 for p in PERCENTILES])
    out = long.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), found.alias("_p"))
    return out.select(key, "mean", "std", *(F.get("_p", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTILES)))


def success_rates(df: DataFrame, task: str, success: str) -> DataFrame:
    """Rate and count of each task, and with a null task of all."""
    return df.rollup(task).agg(F.count(F.lit(1)).alias("episodes"), F.avg(F.col(success).cast("int")).alias("rate"))


def interval_means(df: DataFrame, step: str, interval: int, *values: str) -> DataFrame:
    """Means over windows that end at multiples of the interval; the first has step 0 alone."""
    return df.groupBy(F.ceil(F.col(step) / interval).cast("long").alias("window")).agg(*(F.avg(v).alias(v) for v in values))


def global_norm(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum of the masked values over their number, at least 1."""
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(F.sum(mask.cast("int")), F.lit(1))


def mean_square(a: Column, b: Column) -> Column:
    return F.avg(F.pow(a - b, 2))


def mean_absolute(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def frequency(df: DataFrame, key: str, seconds: Column) -> DataFrame:
    """1 / mean gap between consecutive times; null for fewer than two."""
    gap = seconds - F.lag(seconds).over(Window.partitionBy(key).orderBy(seconds))
    return df.withColumn("_gap", gap).groupBy(key).agg((1.0 / F.avg("_gap")).alias("hz"))


def moving_average(df: DataFrame, key: str, step: str, value: str, decay: float) -> DataFrame:
    """decay * old + (1 - decay) * new over the steps of each key, from the first value: each value times its weight, which its place from the end gives, so
    that no key is gathered in one row. A null value makes the average null."""
    after = Window.partitionBy(key).orderBy(F.col(step).desc(), F.col(value).desc())
    weight = F.pow(F.lit(float(decay)), F.row_number().over(after) - 1) * F.when(F.lead(F.lit(1)).over(after).isNull(), 1.0).otherwise(1.0 - decay)
    total = F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col(value).cast("double") * F.col("_weight")))
    return df.select(key, value, weight.alias("_weight")).groupBy(key).agg(total.alias("ema"))


def next_index(df: DataFrame, column: str) -> DataFrame:
    """The greatest number plus one, or 0."""
    return df.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next"))


def repeated_names(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def equal_lengths(df: DataFrame, key: str, length: str) -> DataFrame:
    """Whether all parts of a key have one length."""
    return df.groupBy(key).agg((F.min(length) == F.max(length)).alias("equal"), F.max(length).alias("length"))


def flags(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(flag).alias("any"), F.bool_and(flag).alias("all"))
