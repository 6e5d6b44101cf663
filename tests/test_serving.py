"""The request loop: bad requests among good ones, batches that are handled twice, restarts, records and metrics."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from trajecta.streaming import serving

OUTPUT = "half double, note string"


def half(rows):
    n = rows.column(rows.schema.get_field_index("n"))
    if pc.any(pc.equal(pc.bit_wise_and(n, 1), 1)).as_py():
        raise ValueError("odd number")
    return pa.RecordBatch.from_arrays([pc.divide(n.cast(pa.float64()), 2.0), pa.array(["ok"] * rows.num_rows)], ["half", "note"])


def requests(spark, numbers):
    return spark.createDataFrame([(i, n, "x") for i, n in numbers], "id long, n long, reply string")


def test_a_bad_request_costs_its_neighbours_nothing(spark):
    got = {r.id: r for r in serving.answered(requests(spark, [(i, 2 * i + (i in (5, 6, 40))) for i in range(64)]).coalesce(1), "id", half, OUTPUT).collect()}
    assert len(got) == 64 and {i for i, r in got.items() if r.error} == {5, 6, 40}
    assert all(r.reply.half == i and r.reply.note == "ok" and r.infer_ms >= 0 for i, r in got.items() if not r.error)
    assert all("odd number" in got[i].error and got[i].reply is None for i in (5, 6, 40))
    short = serving.answered(requests(spark, [(1, 2), (2, 4)]).coalesce(1), "id", lambda rows: half(rows).slice(0, 0), OUTPUT).collect()
    assert all("0 replies to 1 requests" in r.error for r in short)
    assert serving.answered(requests(spark, [(1, 2)]).where("false"), "id", half, OUTPUT).collect() == []


def test_one_reply_across_failures_and_restarts(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = requests(spark, [(0, 0)]).schema
    metrics_of, told = serving.run_id(spark, base, resume=False), []
    assert serving.run_id(spark, base, resume=True) == metrics_of
    listener = serving.Metrics(spark, f"{base}/metrics", metrics_of, ["loop"], [lambda *e: told.append(e)])
    spark.streams.addListener(listener)

    def run(fail=False):
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        writer = serving.serve(stream, "id", half, OUTPUT, f"{base}/replies", f"{base}/state", f"{base}/records", "loop").trigger(availableNow=True)
        if fail:  # after replies and records are written, before the batch is committed
            inner = serving.by_batch(f"{base}/replies"), serving.by_batch(f"{base}/records")

            def broken(df, n):
                answers = serving.answered(df, "id", half, OUTPUT, keep=True)
                inner[0](answers.drop("asked"), n)
                inner[1](serving.recorded(answers, "id"), n)
                raise RuntimeError("executor lost")

            writer = stream.writeStream.foreachBatch(broken).option("checkpointLocation", f"{base}/state").queryName("loop").trigger(availableNow=True)
        writer.start().awaitTermination()

    try:
        requests(spark, [(i, 2 * i + (i == 3)) for i in range(10)]).write.parquet(f"{base}/in")
        with pytest.raises(Exception, match="executor lost"):
            run(fail=True)
        run()
        requests(spark, [(i, 2 * i) for i in range(10, 15)] + [(2, 4)]).write.mode("append").parquet(f"{base}/in")
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    found = serving.replies(spark, f"{base}/replies")
    assert found.count() == 16 and serving.first_replies(found, "id").count() == 15
    assert [(r.id, r.batch) for r in serving.first_replies(found, "id").where("id = 2 OR error IS NOT NULL").orderBy("id").collect()] == [(2, 0), (3, 0)]
    records = serving.replies(spark, f"{base}/records")
    assert sorted(records.columns) == ["batch", "id", "inputs/n", "inputs/reply", "outputs/half", "outputs/note"]
    assert sorted((r.id, r["inputs/n"], r["outputs/half"]) for r in records.collect()) == sorted([(i, 2 * i, float(i)) for i in range(15) if i != 3] + [(2, 4, 2.0)])
    table = serving.metrics(spark, f"{base}/metrics")
    assert {r.run_id for r in table.collect()} == {metrics_of}
    assert sorted((r.batch, r.rows, r.value) for r in table.where("metric = 'requests.n'").collect()) == [(0, 10, 10.0), (1, 6, 6.0)]
    assert table.where("metric = 'addBatch_ms' AND value > 0").count() == 2
    kinds = [e[0] for e in told]
    assert kinds.count("started") == 3 and kinds.count("failed") == 1 and kinds.count("ended") == 2 and ("progress", "loop", 1) in told


def test_run_ids(spark, tmp_path):
    with pytest.raises(Exception, match="run_id"):
        serving.run_id(spark, f"file://{tmp_path}", resume=True)
    first = serving.run_id(spark, f"file://{tmp_path}", resume=False)
    assert serving.run_id(spark, f"file://{tmp_path}", resume=False) != first


def test_recorded_names(spark):
    df = spark.createDataFrame([(1, ((2.0, "a"),), (3,), None)], "id int, asked struct<obs:struct<x:double,s:string>>, reply struct<y:int>, error string")
    assert serving.recorded(df, "id").columns == ["id", "inputs/obs/x", "inputs/obs/s", "outputs/y"]
