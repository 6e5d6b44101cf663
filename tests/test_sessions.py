"""Sessions: state that ends, numbers by session and step, and streams that are stopped and started."""

import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trajecta.operators import sampling
from trajecta.streaming import replay, sessions

SCHEMA = "session long, t long, s double"


class Stream:
    """One stream over rows that come in parts; each part is a run from the checkpoint that the one before left."""

    def __init__(self, spark, base, step):
        self.spark, self.base, self.step = spark, f"file://{base}", step

    def run(self, rows, bounded=True):
        """To the end; or, as a stream with a time to live is never at its end, until all rows that came so far are out."""
        df = self.spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(f"{self.base}/in")
        settings = {"spark.sql.streaming.stateStore.providerClass": replay.ROCKSDB, "spark.sql.shuffle.partitions": "1"}
        before = {k: self.spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            out = self.step(self.spark.readStream.schema(df.schema).parquet(f"{self.base}/in"))
            writer = out.writeStream.format("parquet").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/state")
            query = (writer.trigger(availableNow=True) if bounded else writer.trigger(processingTime="300 milliseconds")).start()
            if bounded:
                query.awaitTermination(60)
            else:
                self.wait(query)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    def wait(self, query):
        there, end = self.spark.read.parquet(f"{self.base}/in").count(), time.time() + 60
        while time.time() < end:
            try:
                if len(self.rows()) == there:
                    break
            except AnalysisException:
                pass
            time.sleep(0.3)
        query.stop()

    def rows(self):
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.base}/out").collect())


def test_an_idle_session_leaves_no_state(spark, tmp_path):
    stream = Stream(spark, tmp_path, lambda df: sessions.session_noise(df.withWatermark("ts", "0 seconds"), "session", 1, idle=30).drop("noise"))
    held = [stream.run([(1, 0, 1000.0), (1, 1, 1010.0), (2, 0, 1005.0)])]
    held.append(stream.run([(2, 1, 1030.0), (2, 2, 1034.9)]))  # within 30 seconds of the session's last row
    held.append(stream.run([(3, 0, 5000.0)]))  # the watermark is past the others' timers after this
    held.append(stream.run([(3, 1, 5001.0)]))
    assert stream.rows() == [(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1), (2, 2, 2), (3, 0, 0), (3, 1, 1)]
    assert held[-1] < held[1] and held[-1] == held[0] // 2
    stream.run([(1, 9, 6000.0)])
    assert stream.rows()[2] == (1, 9, 0)


def test_a_gap_begins_anew_in_any_batch(spark, tmp_path):
    rows = [(s, t, 1000 + 100.0 * s + 20 * t + (30 if t >= 5 else 0)) for s in range(4) for t in range(9)]
    want = sorted((s, t, t if t < 5 else t - 5) for s, t, _ in rows)
    numbers = lambda df: sessions.session_noise(df.withWatermark("ts", "1 day"), "session", 1, idle=50).drop("noise")
    for i, parts in enumerate(([rows], [[r for r in rows if r[1] < 5], [r for r in rows if r[1] >= 5]])):
        stream = Stream(spark, tmp_path / str(i), numbers)
        for part in parts:
            stream.run(part)
        assert stream.rows() == want
    table = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.session, r.t, r.step) for r in sessions.numbered(table, "session", 50).collect()) == want


def test_time_to_live(spark, tmp_path):
    short = Stream(spark, tmp_path / "short", lambda df: sessions.session_noise(df, "session", 1, idle=0.5, clock="processing").drop("noise"))
    short.run([(1, 0, 0.0)], bounded=False)
    time.sleep(1)
    short.run([(1, 1, 0.0)], bounded=False)
    assert short.rows() == [(1, 0, 0), (1, 1, 0)]


def test_noise_is_the_same_everywhere(spark):
    df = spark.createDataFrame([(s, n) for s in (0, 1, -7, 10**17) for n in range(3)], "session long, step long")
    for r in df.withColumn("x", sessions.noise(F.col("session"), F.col("step"), 4, 9)).collect():
        assert r.x == sessions.noise_values(r.session, r.step, 4, 9)
    many = [x for s in range(50) for n in range(20) for x in sessions.noise_values(s, n, 4, 0)]
    assert len(set(many)) > 3990 and abs(sum(many) / len(many) - 0.5) < 0.02
    assert sampling.scrambled_value(-5, 3) == spark.range(1).select(sampling.scrambled(F.lit(-5), 3)).first()[0]


def test_an_episode_that_was_idle_takes_a_new_chunk(spark):
    rows = spark.createDataFrame([(1, t, [100.0 * t + k for k in range(3)], 1000 + t * 10 + (60 if t >= 4 else 0)) for t in range(7)], "episode long, t int, chunk array<double>, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = replay.run_bounded(rows, lambda df: replay.chunk_replay(df.withWatermark("ts", "1 day"), 3, idle=30), (F.col("t") < 2, F.col("t") >= 2))
    assert [tuple(r)[1:4] for r in got.orderBy("t").collect()] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 3, 0), (4, 4, 0), (5, 4, 1), (6, 4, 2)]
    runs = replay.run_bounded(rows.withColumn("complete", F.col("t") == 2), lambda df: replay.lifecycle(df.withWatermark("ts", "1 day"), 100, idle=30))
    assert [tuple(r)[1:] for r in runs.orderBy("t").collect()] == [(0, 1, False), (1, 2, False), (2, 3, True), (4, 1, False), (5, 2, False), (6, 3, False)]


def test_settings():
    for bad in ({"clock": "wall"}, {"idle": 0}):
        with pytest.raises(ValueError):
            sessions.Noise(1, 0, ("a",), **bad)
