"""Sequence operators within an episode: dense index, action chunks, idle runs, keep ranges, replay.

All shuffle by episode once; windows over the same episode and order share that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(episode: str, *order: str) -> WindowSpec:
    return Window.partitionBy(episode).orderBy(*order)


def step_index(df: DataFrame, episode: str, order: Sequence[str], name: str = "t") -> DataFrame:
    """0, 1, ... within each episode."""
    return df.withColumn(name, F.row_number().over(by(episode, *order)) - 1)


def chunk(value: Column, episode: str, order: str, horizon: int) -> Column:
    """The next `horizon` values from the current step on; past the episode's end the last is repeated."""
    window = by(episode, order)
    ahead = F.collect_list(value).over(window.rowsBetween(0, horizon - 1))
    return F.concat(ahead, F.array_repeat(F.element_at(ahead, -1), F.lit(horizon) - F.size(ahead)))


def chunk_array(values: Column, t: Column, horizon: int) -> Column:
    """The same from an episode's whole array."""
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.get(values, F.least(t + k, F.size(values) - 1).cast("int")))


def idle(value: Column, episode: str, order: str, threshold: float = 1e-3) -> Column:
    """Whether all elements moved less than `threshold` since the step before; the first step is not idle."""
    before = F.lag(value).over(by(episode, order))
    still = F.forall(F.zip_with(value, before, lambda a, b: F.abs(a - b) < threshold), lambda x: x)
    return F.coalesce(still, F.lit(False))


def islands(df: DataFrame, flag: str, episode: str, order: str) -> DataFrame:
    """Maximal runs of equal flags: episode, flag, start, end (half-open)."""
    window = by(episode, order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(window)).cast("int"), F.lit(1))
    runs = df.withColumn("_change", change).withColumn("_run", F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(episode, "_run", flag).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_run")


def keep_ranges(df: DataFrame, flag: str, episode: str, order: str, least_idle: int = 7, least_keep: int = 16, trim: int = 10) -> DataFrame:
    """Ranges to keep: what is left when idle runs of at least `least_idle` steps go, where that has at least `least_keep` steps, less `trim` at the end.

    Runs of at least the limit count (not more than it)."""
    runs = islands(df, flag, episode, order)
    dropped = runs.withColumn("_gone", F.col(flag) & (F.col("end") - F.col("start") >= least_idle))
    # Neighbouring runs that stay are one range: number them by the dropped ones before.
    before = F.sum(F.col("_gone").cast("int")).over(by(episode, "start").rowsBetween(Window.unboundedPreceding, 0))
    kept = dropped.withColumn("_range", before).where(~F.col("_gone")).groupBy(episode, "_range").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return kept.where(F.col("end") - F.col("start") >= least_keep).select(episode, "start", (F.col("end") - trim).alias("end"))


def replay(t: Column, horizon: int) -> tuple[Column, Column]:
    """The step at which the chunk in use was queried, and the place in it."""
    return (F.floor(t / horizon) * horizon).cast("int"), (t % horizon).cast("int")


def within_limit(t: Column, limit: int, one_more: bool = True) -> Column:
    """Steps that a run with a step limit executes; the limit is tested before counting, so one more."""
    return t <= limit if one_more else t < limit


def waiting(t: Column, no_op: int = 10, every: int = 5) -> tuple[Column, Column]:
    """Whether a step is one of the first no-ops, and whether it plans anew."""
    return t < no_op, (t >= no_op) & ((t - no_op) % every == 0)


# The greatest number of steps by task suite.
SUITE_STEPS = {"libero_spatial": 220, "libero_object": 280, "libero_goal": 300, "libero_10": 520, "libero_90": 400}


def suite_limit(suite: Column, no_op: int = 10) -> Column:
    """The number of steps that a run of a suite may take, the first no-ops included; an unknown suite is an error."""
    steps = F.create_map(*(F.lit(x) for pair in SUITE_STEPS.items() for x in pair))
    error = F.raise_error(F.concat(F.lit("unknown task suite "), F.coalesce(suite, F.lit("null"))))
    return F.coalesce(F.try_element_at(steps, F.coalesce(suite, F.lit(""))), error.cast("int")) + no_op


def previous(value: Column, episode: str, order: str) -> Column:
    return F.lag(value).over(by(episode, order))


def last_n(value: Column, episode: str, order: str, n: int = 50) -> Column:
    """The last n values, the current one included: a ring buffer."""
    return F.collect_list(value).over(by(episode, order).rowsBetween(-(n - 1), 0))


def prefix_complete(df: DataFrame, ok: str, episode: str, order: str) -> DataFrame:
    """The steps before the first one that is not ok."""
    failed = F.sum((~F.col(ok)).cast("int")).over(by(episode, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_failed", failed).where("_failed = 0").drop("_failed")


def attention(df: DataFrame, episode: str, t: str, ar: str, ok: str, block: int = 1024) -> DataFrame:
    """episode, i, j, visible for all pairs of an episode's steps: both are ok and the running sum of ar at j is at most that at i.

    Pairs meet in squares of `block` steps, so that no task holds a long episode's whole mask."""
    sums = df.select(F.col(episode).alias("episode"), F.col(t).alias("t"), F.col(ok).alias("ok"), F.sum(F.col(ar).cast("int")).over(by(episode, t)).alias("s"), F.floor(F.max(t).over(Window.partitionBy(episode)) / block).alias("top"))
    own, others = F.floor(F.col("t") / block), F.explode(F.sequence(F.lit(0).cast("long"), F.col("top")))
    left = sums.select("episode", own.alias("_i"), others.alias("_j"), F.col("t").alias("i"), F.col("s").alias("_si"), F.col("ok").alias("_oi"))
    right = sums.select("episode", others.alias("_i"), own.alias("_j"), F.col("t").alias("j"), F.col("s").alias("_sj"), F.col("ok").alias("_oj"))
    return left.join(right, ["episode", "_i", "_j"]).select("episode", "i", "j", ((F.col("_sj") <= F.col("_si")) & F.col("_oi") & F.col("_oj")).alias("visible"))
