"""Queries of the request loop: turns of conversations come as a stream of requests, some of them bad, and are answered, recorded and counted."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from trajecta.plans.catalog import query, table
from trajecta.sources import datasets
from trajecta.streaming import serving

ASKED = "SELECT conv_id * 1000 + turn AS request, role, length(text) AS n FROM conversations"
NAME = "turns"


def handle(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Twice the length and the role's first letter; a length that 13 divides is a bad request."""
    n = rows.column(rows.schema.get_field_index("n"))
    if any(x % 13 == 0 for x in n.to_pylist()):
        raise ValueError("a bad length")
    letter = pc.utf8_slice_codeunits(rows.column(rows.schema.get_field_index("role")), 0, 1)
    return pa.RecordBatch.from_arrays([pc.multiply(n, 2), letter], ["twice", "letter"])


def served(spark, sf_dir):
    """The stream run to its end; the folder that has its replies, records and metrics."""
    base = datasets.scratch(spark, "requests")
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request"), "role", F.length("text").cast("long").alias("n"))
    asked.write.parquet(f"{base}/in")
    run = serving.run_id(spark, base, resume=False)
    listener = serving.Metrics(spark, f"{base}/metrics", run, [NAME])
    spark.streams.addListener(listener)
    try:
        requests = spark.readStream.schema(asked.schema).parquet(f"{base}/in")
        stream = serving.serve(requests, "request", handle, "twice long, letter string", f"{base}/replies", f"{base}/state", f"{base}/records", NAME).trigger(availableNow=True).start()
        stream.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return base


@query("request_replies", f"SELECT request, CASE WHEN n % 13 <> 0 THEN n * 2 END AS twice, CASE WHEN n % 13 <> 0 THEN left(role, 1) END AS letter, n % 13 = 0 AS failed FROM ({ASKED})")
def request_replies(spark, sf_dir):
    found = serving.first_replies(serving.replies(spark, f"{served(spark, sf_dir)}/replies"), "request")
    return found.select("request", "reply.twice", "reply.letter", F.contains("error", F.lit("a bad length")).alias("failed")).withColumn("failed", F.coalesce("failed", F.lit(False)))


@query("recorded_steps", f"SELECT request, role AS input_role, n AS input_n, n * 2 AS output_twice FROM ({ASKED}) WHERE n % 13 <> 0")
def recorded_steps(spark, sf_dir):
    found = serving.replies(spark, f"{served(spark, sf_dir)}/records")
    return found.select("request", F.col("`inputs/role`").alias("input_role"), F.col("`inputs/n`").alias("input_n"), F.col("`outputs/twice`").alias("output_twice"))


@query("run_metrics", f"SELECT '{NAME}' AS name, CAST(1 AS BIGINT) AS runs, count(*) AS rows, count(*) AS observed FROM conversations")
def run_metrics(spark, sf_dir):
    """What the run's metrics say of its streams: the rows that Spark counted, and those that the stream observed."""
    found = serving.metrics(spark, f"{served(spark, sf_dir)}/metrics").where("metric = 'requests.n'")
    return found.groupBy("name").agg(F.countDistinct("run_id").alias("runs"), F.sum("rows").alias("rows"), F.sum("value").cast("long").alias("observed"))
