"""Frames looked up by time: chunks of future frames at offsets of k / fps, and checks of a recording's clock.

A recording's clock is not exact: frames come a little early or late, and some are missing. A chunk therefore asks for times, not for the next rows. The
frames of an episode meet in buckets of time with a halo of one chunk, so that an episode of any length is spread over many tasks, and one sorted
pass over a bucket gives each frame what is ahead of it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 1e-4
MISSES = ("error", "null", "hold")


def time_chunks(df: DataFrame, values: Mapping[str, str], episode: str, ts: str, horizon: int, fps: float, tolerance: float = TOLERANCE, miss: str = "error", bucket: int = 4096) -> DataFrame:
    """df with an array for each of `values` (new name to column): element k is of the frame at ts + k / fps, and is_pad tells which elements are past the episode's end.

    The frame is the nearest one within the tolerance, of equals the earlier. Past the end (by more than the tolerance) the last frame is repeated. Where
    the episode goes on and has no frame at that time, `miss` decides: an error, a null (is_missing then tells where), or the last frame before it ("hold").
    A frame without a time misses everything. Values must be orderable: of two frames at the same time and distance, the lesser value counts. Times of an
    episode are taken in buckets of `bucket` / fps seconds."""
    if miss not in MISSES:
        raise ValueError(f"miss is one of {MISSES}")
    if horizon < 1 or fps <= 0:
        raise ValueError("a chunk needs a horizon of at least 1 and a positive rate")
    span, width = (horizon - 1) / fps + 2 * tolerance, max(bucket, 2 * horizon + 2) / fps
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    at = F.col(names[ts]).cast("double")
    rows = df.toDF(*names.values())
    ends = rows.groupBy(F.col(names[episode]).alias("_episode")).agg(F.max(at).alias("_end"))
    rows = rows.join(ends, F.col(names[episode]).eqNullSafe(F.col("_episode")), "left").withColumns({"_t": at, "_own": F.floor(at / width)})
    # What a bucket's last frames look ahead to is in the first `span` seconds of the next one.
    early = F.col("_t") - F.col("_own") * width <= span
    rows = rows.withColumn("_bucket", F.explode(F.when(early, F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array("_own"))))
    rows = rows.withColumn("_frame", F.struct(F.col("_t").alias("t"), *(F.col(names[c]).alias(n) for n, c in values.items())))
    # The column API takes whole numbers only for a range.
    window = f"PARTITION BY {names[episode]}, _bucket ORDER BY _t RANGE BETWEEN {2 * tolerance!r}D PRECEDING AND {span!r}D FOLLOWING"
    seen = rows.withColumn("_ahead", F.expr(f"collect_list(_frame) OVER ({window})")).where("_bucket <=> _own")
    slot = lambda x: F.round((x["t"] - F.col("_t")) * fps).cast("int")
    off = lambda x: F.abs(x["t"] - (F.col("_t") + slot(x) / F.lit(float(fps))))
    hits = F.array_sort(F.filter(F.transform("_ahead", lambda x: F.struct(slot(x).alias("k"), off(x).alias("off"), x.alias("frame"))), lambda x: x["off"] <= tolerance))
    seen = seen.withColumn("_hits", hits).withColumn("_slots", F.transform("_hits", lambda x: x["k"]))

    def found(k: Column) -> Column:
        """frame, pad and missing of element k."""
        place, q = F.array_position("_slots", k).cast("int"), F.col("_t") + k / F.lit(float(fps))
        hit, past = place > 0, q > F.col("_end") + tolerance
        before = F.array_max(F.filter("_ahead", lambda x: x["t"] <= q + tolerance))
        rest = before if miss == "hold" else F.lit(None)
        frame = F.when(hit, F.try_element_at("_hits", F.when(hit, place))["frame"]).when(past, F.array_max("_ahead")).otherwise(rest)
        lost = ~hit & ~F.coalesce(past, F.lit(False))
        if miss == "error":
            text = F.concat(F.lit("no frame within the tolerance of time "), F.coalesce(q.cast("string"), F.lit("null")), F.lit(" in episode "), F.coalesce(F.col(names[episode]).cast("string"), F.lit("null")))
            frame = F.when(lost, F.raise_error(text)).otherwise(frame)
        return F.struct(frame.alias("frame"), (~hit & F.coalesce(past, F.lit(False))).alias("pad"), lost.alias("missing"))

    seen = seen.withColumn("_chunk", F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), found))
    out = {n: F.transform("_chunk", lambda x: x["frame"][n]) for n in values} | {"is_pad": F.transform("_chunk", lambda x: x["pad"])}
    if miss != "error":
        out["is_missing"] = F.transform("_chunk", lambda x: x["missing"])
    kept = [c for c in df.columns if c not in out]
    return seen.select(*(F.col(names[c]).alias(c) for c in kept), *(v.alias(n) for n, v in out.items()))


def out_of_sync(df: DataFrame, episode: str, ts: str, fps: float, tolerance: float = TOLERANCE) -> DataFrame:
    """Frames whose time since the frame before is not 1 / fps, with `step`, that time; a frame without a time is one of them."""
    step = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(Window.partitionBy(episode).orderBy(ts))
    bad = F.col(ts).isNull() | (F.abs(F.col("step") - 1 / fps) > tolerance)
    return df.withColumn("step", step).where(bad)
