"""Queries that go through files of other formats: what a job writes is read back and held against the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajecta.functions import mp4
from trajecta.plans.catalog import query, table
from trajecta.sources import datasets, records, video

TURNS = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS t, turn, role, text FROM conversations"


@query(
    "record_trajectories",
    f"""SELECT conv_id, t, role, md5(text) AS text_md5, turn AS state_turn, length(text) AS state_length, CAST(CAST(length(text) AS FLOAT) / CAST(1000 AS FLOAT) AS DOUBLE) AS share FROM ({TURNS})""",
)
def record_trajectories(spark, sf_dir):
    """Conversations written as one record each, with flat features, and read back as steps."""
    turns = table(spark, sf_dir, "conversations").withColumn("share", F.length("text").cast("float") / F.lit(1000).cast("float"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "share")))
    whole = turns.groupBy("conv_id").agg(rows.alias("rows"))
    flat = whole.select(
        F.col("conv_id").alias("id"),
        F.transform("rows", lambda r: r["role"]).alias("steps/role"),
        F.transform("rows", lambda r: r["text"]).alias("steps/text"),
        F.flatten(F.transform("rows", lambda r: F.array(r["turn"], F.length(r["text"]).cast("long")))).alias("steps/state"),
        F.transform("rows", lambda r: r["share"].cast("float")).alias("steps/share"),
    )
    path = datasets.scratch(spark, "trajectories")
    records.write_records(flat, path)
    read = records.read_records(spark, path, "id long, `steps/role` array<string>, `steps/text` array<string>, `steps/state` array<long>, `steps/share` array<float>", mode="FAILFAST")
    out = records.steps(read, {"steps/role": 0, "steps/text": 0, "steps/state": 2, "steps/share": 0}, {"conv_id": "id"})
    return out.select("conv_id", "t", F.col("steps/role").alias("role"), F.md5("steps/text").alias("text_md5"), F.get("steps/state", F.lit(0)).alias("state_turn"), F.get("steps/state", F.lit(1)).alias("state_length"), F.col("steps/share").cast("double").alias("share"))


def clips(batches):
    """Conversations as video files: a turn's text is a frame, and every fourth one stands alone."""
    for batch in batches:
        made = [mp4.muxed([x.encode() for x in texts], 10, keys=range(0, len(texts), 4), chunk=3) for texts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["conv_id", "content"])


@query("video_frames", f"""SELECT conv_id, CAST(t AS BIGINT) AS frame, CAST(strlen(text) AS BIGINT) AS size, t / 10e0 AS time, t % 4 = 0 AS key, md5(text) AS data_md5 FROM ({TURNS})""")
def video_frames(spark, sf_dir):
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    files = whole.select("conv_id", F.transform("rows", lambda r: r["text"]).alias("texts")).mapInArrow(clips, "conv_id long, content binary")
    return video.frames(files, keys=["conv_id"], data=True).select("conv_id", "frame", "size", "time", "key", F.md5("data").alias("data_md5"))


@query(
    "camera_lockstep",
    """WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i, length(text) AS v FROM conversations WHERE role IN ('user', 'assistant')),
 e AS (SELECT conv_id, role, coalesce(min(i) FILTER (v % 7 = 0), max(i) + 1) AS stop FROM f GROUP BY conv_id, role), s AS (SELECT conv_id, min(stop) AS stop FROM e GROUP BY conv_id HAVING count(*) = 2)
 SELECT a.conv_id, a.i AS frame, a.v AS user, b.v AS assistant FROM f a JOIN f b ON b.conv_id = a.conv_id AND b.i = a.i AND b.role = 'assistant' JOIN s ON s.conv_id = a.conv_id WHERE a.role = 'user' AND a.i < stop""",
)
def camera_lockstep(spark, sf_dir):
    """Roles as cameras: frames side by side up to the first that one of them lacks; one of seven reads fails."""
    by = Window.partitionBy("conv_id", "role").orderBy("turn")
    frames = table(spark, sf_dir, "conversations").select("conv_id", "role", (F.row_number().over(by) - 1).alias("frame"), F.length("text").cast("long").alias("v"))
    return video.lockstep(frames.withColumn("ok", F.col("v") % 7 != 0), "conv_id", "role", "frame", "v", ["user", "assistant"], "ok", block=64)
