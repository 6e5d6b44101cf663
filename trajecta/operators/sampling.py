"""Shuffling, batching, mixing and sharding by keyed hashes, so that results do not depend on partitions.

`scrambled` is arithmetic that other SQL engines can repeat. Global positions come from a two-step count (per range of the hash, then over
the ranges), not from one sorted task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODULUS = 4_294_967_296
RANGES = 1024


def scrambled(key: Column, seed: int = 0) -> Column:
    """A number below 2**32 for an integer key."""
    x = (F.pmod(key.cast("long"), F.lit(3_000_000_000)) * 2_654_435_761 + seed * 40_503) % MODULUS
    return (x.bitwiseXOR(F.shiftright(x, 15)) * 1_540_483_477) % MODULUS


def scrambled_value(key: int, seed: int = 0) -> int:
    """The same of a Python number."""
    x = (key % 3_000_000_000 * 2_654_435_761 + seed * 40_503) % MODULUS
    return ((x ^ x >> 15) * 1_540_483_477) % MODULUS


def unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1)."""
    return scrambled(key, seed) / MODULUS


def positioned(df: DataFrame, key: str, seed: int | None, name: str = "position") -> DataFrame:
    """0, 1, ... in order of the key's hash, or without a seed in order of the integer key itself.

    Rows are counted by range of the order value; the counts, a bounded number, give each range its start."""
    order = scrambled(F.col(key), seed) if seed is not None else F.col(key)
    if seed is None:
        low, high = df.agg(F.min(key), F.max(key)).first()
        width = max(1, -(-((high or 0) - (low or 0) + 1) // RANGES))
        ranged = df.withColumns({"_order": order, "_range": F.floor((F.col(key) - F.lit(low or 0)) / width)})
    else:
        ranged = df.withColumns({"_order": order, "_range": F.floor(order / (MODULUS // RANGES))})
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_order", key)) - 1
    return ranged.withColumn("_within", within).join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_range", "_order", "_within", "_start")


def batches(df: DataFrame, position: str, size: int, drop_last: bool = True, name: str = "batch_id") -> DataFrame:
    """Batch numbers; an incomplete last batch is dropped, and fewer rows than one batch are an error."""
    out = df.withColumn(name, F.floor(F.col(position) / size).cast("long"))
    if not drop_last:
        return out
    n = df.count()
    if n < size:
        raise ValueError(f"{n} rows do not fill a batch of {size}")
    return out.where(F.col(name) < n // size)


def epochs(df: DataFrame, batch: str, per_epoch: int | None, n: int, name: str = "step") -> DataFrame:
    """n batches, going round again after each epoch; without per_epoch an epoch is all batches of the table."""
    if per_epoch is None:
        per_epoch = (df.agg(F.max(batch)).first()[0] or 0) + 1
    rounds = -(-n // per_epoch)
    out = df.where(F.col(batch) < per_epoch).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return out.withColumn(name, (F.col("_round") * per_epoch + F.col(batch)).cast("long")).where(F.col(name) < n).drop("_round")


def sharded(df: DataFrame, position: str, rank: int, world: int) -> DataFrame:
    """The rows of one of `world` readers, equally many for each."""
    n = df.count() // world * world
    return df.where((F.col(position) < n) & (F.col(position) % world == rank))


def mixed(parts: Mapping[str, tuple[DataFrame, float]], key: str, seed: int = 0) -> DataFrame:
    """A union in which each source keeps its rows with a chance in proportion to its weight, the greatest weight 1."""
    total = sum(w for _, w in parts.values())
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"weights sum to {total}")
    top = max(w for _, w in parts.values())
    out = None
    for name, (df, weight) in parts.items():
        part = df.withColumn("source", F.lit(name)).where(unit(F.col(key), seed) < weight / top)
        out = part if out is None else out.unionByName(part)
    return out


def concatenated(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all sources, with their source."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def chosen(key: Column, options: Column, seed: int = 0) -> Column:
    """One element of an array, by the key's hash."""
    return F.get(options, (scrambled(key, seed) % F.size(options)).cast("int"))


def step_subset(df: DataFrame, episode: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n steps of each episode, those with the least hashes."""
    rank = F.row_number().over(Window.partitionBy(episode).orderBy(scrambled(F.col(key), seed), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def trajectory_sample(df: DataFrame, episode: str, step: str, n: int, moving: str | None = None, share: float = 1.5, seed: int = 0) -> DataFrame:
    """At most n steps of each episode, drawn by hash without replacement: n of its steps, or, where those that do not move are dropped, n * share of them, of which
    the moving ones stay, and n of these at most. In a table the steps keep their order by `step`; Spark cuts each task's part of an episode to the draw before it shuffles."""
    order = [scrambled(scrambled(F.col(episode), seed) + F.col(step), seed + 1), F.col(step)]
    drawn = df.withColumn("_rank", F.row_number().over(Window.partitionBy(episode).orderBy(*order))).where(F.col("_rank") <= (int(n * share) if moving else n))
    if moving is None:
        return drawn.drop("_rank")
    kept = drawn.where(F.coalesce(F.col(moving), F.lit(True)))
    return kept.withColumn("_rank", F.row_number().over(Window.partitionBy(episode).orderBy("_rank"))).where(F.col("_rank") <= n).drop("_rank")


def truncated(df: DataFrame, position: str, max_rows: int, batch: int) -> DataFrame:
    """The first max_rows // batch whole batches in order of position."""
    return df.where(F.col(position) < max_rows // batch * batch)


def retained(df: DataFrame, step: str, period: int) -> DataFrame:
    """The latest step and all multiples of the period."""
    top = df.agg(F.max(step).alias("_top"))
    return df.join(F.broadcast(top), (F.col(step) == F.col("_top")) | (F.col(step) % period == 0)).drop("_top")


def saves(step: Column, interval: int, start: int, last: int) -> Column:
    """Whether a step is saved: each interval after the start, and the last."""
    return ((step % interval == 0) & (step > start)) | (step == last)


def largest_divisible(shape: Column, by: int) -> Column:
    """The axis of the greatest extent that `by` divides, the later of equals; null if none."""
    axes = F.filter(F.transform(shape, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"] % by == 0)
    return F.array_max(axes)["i"]
