"""Stateful streaming: chunk replay by episode, episode lifecycle, windowed counts, and a request loop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trajecta.streaming import sessions


class ChunkReplay(sessions.Session):
    """Emits one action for each step of an episode from its chunk in use: a new chunk is taken when there is none or `horizon` steps of it
    are spent, else the state's next element is replayed."""

    fields = "chunk array<double>, step int, query int"
    columns = ("episode", "t", "query", "place", "action")

    def __init__(self, horizon: int, **session):
        super().__init__(**session)
        self.horizon = horizon

    def fresh(self) -> tuple:
        return [], 0, -1

    def step(self, key: tuple, state: tuple, row) -> tuple[tuple, tuple]:
        chunk, step, query = state
        if query < 0 or step >= self.horizon:
            chunk, step, query = [float(v) for v in row.chunk], 0, int(row.t)
        return (list(chunk), step + 1, query), (int(row.t), query, step, chunk[step])


def chunk_replay(steps: DataFrame, horizon: int, idle: float | None = None, clock: str = "event", ts: str = "ts") -> DataFrame:
    """steps (episode, t, chunk) as a stream to (episode, t, query, place, action). With `idle` an episode's state ends after so many seconds without a
    step, by the column ts or by the clock (see sessions)."""
    return sessions.run(steps, "episode", ChunkReplay(horizon, idle=idle, clock=clock, ts=ts), "episode long, t int, query int, place int, action double")


class Lifecycle(sessions.Session):
    """Counts an episode's steps until it is complete or past its limit; later steps are not executed. The limit is tested before a step counts,
    so limit + 1 steps run."""

    fields = "steps int, over boolean"
    columns = ("episode", "t", "steps", "last")

    def __init__(self, limit: int, **session):
        super().__init__(**session)
        self.limit = limit

    def fresh(self) -> tuple:
        return 0, False

    def step(self, key: tuple, state: tuple, row) -> tuple[tuple, tuple | None]:
        steps, over = state
        if over:
            return state, None
        over = bool(row.complete) or (self.limit > 0 and steps >= self.limit)
        return (steps + 1, over), (int(row.t), steps + 1, over)


def lifecycle(steps: DataFrame, limit: int, idle: float | None = None, clock: str = "event", ts: str = "ts") -> DataFrame:
    """steps (episode, t, complete) as a stream to the executed ones (episode, t, steps, last). With `idle` an episode that is silent so long ends, and a later step begins a new run."""
    return sessions.run(steps, "episode", Lifecycle(limit, idle=idle, clock=clock, ts=ts), "episode long, t int, steps int, last boolean")


def served(requests: DataFrame, handle: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, max_hz: float | None = None) -> DataStreamWriter:
    """A request loop: each micro-batch of requests is handled and its replies given to the sink, at most `max_hz` times a second."""
    writer = requests.writeStream.foreachBatch(lambda df, n: sink(handle(df), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{max(1, int(1000 / max_hz))} milliseconds") if max_hz else writer.trigger(availableNow=True)


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: counts by event-time window with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_bounded(rows: DataFrame, step: Callable[[DataFrame], DataFrame], parts: Sequence[Column] = ()) -> DataFrame:
    """A stateful stream over rows that are there already: they are written to the shared folder, streamed to the end, and the result is read back.

    With `parts`, conditions on the rows, the stream is stopped after the rows of each and started again from its checkpoint with those of the next."""
    spark = rows.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='trajecta-')}"
    base = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    out = None
    for part in parts or (F.lit(True),):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        spark.conf.set(provider, ROCKSDB)
        try:
            out = step(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
            query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{base}/out")
