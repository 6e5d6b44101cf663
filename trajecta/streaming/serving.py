"""Serving requests from a stream: one reply for each request, errors as replies, recorded steps, and a run's metrics.

A micro-batch is written under its number, in place of what an earlier try of the same batch left there. So after a failure and a restart each request has one reply,
each step one record, and each batch one row of metrics, though a batch may have been handled more than once.
"""

from __future__ import annotations

import json
import time
import traceback
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from trajecta.operators.structure import flatten

Handler = Callable[[pa.RecordBatch], pa.RecordBatch]


def answered(requests: DataFrame, key: str, handle: Handler, output: str | T.StructType, keep: bool = False) -> DataFrame:
    """key, reply (a struct of the output's fields; null if the request failed), error (null if it did not), infer_ms of every request; with `keep` its other columns as the struct `asked`.

    handle gets a batch of requests, without the key, and returns as many rows of the output. If it raises, the batch is handled in halves, down to the
    requests that fail by themselves: one bad request costs its neighbours some time, not their replies."""
    schema = T.StructType.fromDDL(output) if isinstance(output, str) else output
    out = T.StructType([requests.schema[key], T.StructField("reply", schema), T.StructField("error", T.StringType()), T.StructField("infer_ms", T.DoubleType())])
    given = [c for c in requests.columns if c != key]
    asked = T.StructType([requests.schema[c] for c in given])
    if keep:
        out = out.add("asked", asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(T.StructType([T.StructField("reply", schema)])).field(0).type

        def parts(keys: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            start, n = time.monotonic(), rows.num_rows
            try:
                made = handle(rows)
                if made.num_rows != n:
                    raise ValueError(f"{made.num_rows} replies to {n} requests")
                reply = pa.StructArray.from_arrays([made.column(made.schema.get_field_index(f.name)).cast(f.type) for f in kind], fields=list(kind))
                error = pa.nulls(n, pa.string())
            except Exception:
                if n > 1:
                    half = n // 2
                    yield from parts(keys.slice(0, half), rows.slice(0, half))
                    yield from parts(keys.slice(half), rows.slice(half))
                    return
                reply, error = pa.nulls(1, kind), pa.array([traceback.format_exc(limit=-3)])
            took = pa.array([(time.monotonic() - start) * 1000.0] * n)
            more = [pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema))] if keep else []
            yield pa.RecordBatch.from_arrays([keys, reply, error, took, *more], out.names)

        for batch in batches:
            if batch.num_rows:
                yield from parts(batch.column(0), batch.select(batch.schema.names[1:]))

    return requests.select(key, *given).mapInArrow(run, out)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: the rows of a batch under its number, whatever was there before."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def serve(requests: DataFrame, key: str, handle: Handler, output: str | T.StructType, path: str, checkpoint: str, record: str | None = None, name: str | None = None) -> DataStreamWriter:
    """A stream of requests to one reply each, in a table at `path` (read it with `replies`). The trigger is the caller's.

    With `record`, each request that was answered is also written there with its reply, flattened to inputs/... and outputs/... columns. The number of requests is observed as requests.n."""
    sink, recorder = by_batch(path), by_batch(record) if record else None

    def run(df: DataFrame, batch: int) -> None:
        out = answered(df, key, handle, output, keep=recorder is not None)
        if recorder is None:
            sink(out, batch)
            return
        out.persist()
        try:
            sink(out.drop("asked"), batch)
            recorder(recorded(out, key), batch)
        finally:
            out.unpersist()

    writer = requests.observe("requests", F.count(F.lit(1)).alias("n")).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.queryName(name) if name else writer


def recorded(out: DataFrame, key: str) -> DataFrame:
    """answered() requests that did not fail, with what was asked and the reply as flat columns: key, inputs/..., outputs/... ."""
    return flatten(out.where("error IS NULL").select(key, F.col("asked").alias("inputs"), F.col("reply").alias("outputs")))


def replies(spark: SparkSession, path: str) -> DataFrame:
    """All replies so far, with the batch of each. A key that was asked more than once, in several batches, has the reply of the first."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def first_replies(found: DataFrame, key: str) -> DataFrame:
    """One reply for each key: of the earliest batch, and in it one without an error if there is one."""
    rest = F.struct(*(c for c in found.columns if c != key))
    rank = F.struct("batch", F.col("error").isNotNull(), F.coalesce("error", F.lit("")))
    return found.groupBy(key).agg(F.min_by(rest, rank).alias("_r")).select(key, "_r.*")


def run_id(spark: SparkSession, folder: str, resume: bool) -> str:
    """The id of a run, kept in the folder so that a run that is resumed goes on under it. A new run takes a new id; resuming without one is an error."""
    from trajecta.sources.datasets import _read_text, _write_text

    path = f"{folder}/run_id.json"
    if resume:
        return json.loads(_read_text(spark, path))["run_id"]
    new = uuid.uuid4().hex
    _write_text(spark, path, json.dumps({"run_id": new}))
    return new


class Metrics(StreamingQueryListener):
    """Writes what each batch of the named streams took and observed to a table: run_id, name, batch, at, rows, took_ms, metric, value. A batch that is
    reported again replaces its rows. Streams of other names pass by. Subscribers are called with (event, name, batch) as streams start, go on and end."""

    SCHEMA = "run_id string, name string, batch long, at string, rows long, took_ms long, metric string, value double"

    def __init__(self, spark: SparkSession, path: str, run: str, names: Sequence[str] = (), subscribers: Sequence[Callable[[str, str | None, int | None], None]] = ()):
        self.spark, self.path, self.run, self.names, self.subscribers, self.named = spark, path, run, set(names), list(subscribers), {}

    def _tell(self, event: str, name: str | None, batch: int | None = None) -> None:
        for s in self.subscribers:
            s(event, name, batch)

    def _mine(self, name: str | None) -> bool:
        return not self.names or name in self.names

    def onQueryStarted(self, event) -> None:
        self.named[str(event.runId)] = event.name
        if self._mine(event.name):
            self._tell("started", event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not self._mine(p.name) or not p.numInputRows:
            return
        values = {"input_rows_per_second": p.processedRowsPerSecond} | {f"{o}.{k}": v for o, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()} | {f"{k}_ms": v for k, v in p.durationMs.items()}
        head = (self.run, p.name, p.batchId, p.timestamp, p.numInputRows, p.batchDuration)
        rows = [(*head, k, None if v is None else float(v)) for k, v in sorted(values.items()) if v is None or isinstance(v, (int, float))]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={self.run}/stream={p.name}/batch_id={p.batchId}")
        self._tell("progress", p.name, p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.named.pop(str(event.runId), None)
        if self._mine(name):
            self._tell("ended" if event.exception is None else "failed", name)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """The table that Metrics writes."""
    return spark.read.schema(Metrics.SCHEMA).option("recursiveFileLookup", "true").parquet(path)
