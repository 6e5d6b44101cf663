"""Queries use all rows of their tables."""

import pytest
from pyspark.sql import functions as F

from trajecta.operators import sampling, sequence
from trajecta.plans import catalog
from trajecta.streaming import replay


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with events of one long and two short episodes."""
    folder = tmp_path_factory.mktemp("events")
    sizes = {1: 430, 2: 7, 3: 45}
    rows = [(100 * t + u, u, t, float((t * 7 + u) % 100)) for u, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double")
    df.select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit("view").alias("event_type"), "value").write.parquet(f"{folder}/events.parquet")
    return str(folder), rows


@pytest.mark.parametrize("name", ["streaming_chunk_replay", "streaming_lifecycle"])
def test_all_steps_are_streamed(spark, events, monkeypatch, name):
    streamed = []
    run = replay.run_bounded
    monkeypatch.setattr(replay, "run_bounded", lambda rows, step: streamed.append(rows.count()) or run(rows, step))
    got = sorted((r.episode, r.t) for r in catalog.queries()[name](spark, events[0]).collect())
    assert streamed == [len(events[1])]
    bound = {"streaming_lifecycle": 7}.get(name, 1000)
    assert got == sorted((u, t) for _, u, t, _ in events[1] if t < bound)


def test_replay_of_long_episodes(spark, events):
    got = sorted((r.episode, r.t, r["query"], r.place, r.action) for r in catalog.queries()["streaming_chunk_replay"](spark, events[0]).collect())
    assert got == sorted((u, t, t // 5 * 5, t % 5, v + t // 5 * 5 * 1000) for _, u, t, v in events[1])


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_attention_of_whole_sequences(spark, block):
    rows = [(e, t, (t * e) % 3 == 1, (t + e) % 5 > 0) for e, n in ((1, 40), (2, 1), (3, 21)) for t in range(n)]
    want = []
    for e in (1, 2, 3):
        mine = [r for r in rows if r[0] == e]
        sums = [sum(r[2] for r in mine[: i + 1]) for i in range(len(mine))]
        want += [(e, i, j, sums[j] <= sums[i] and a[3] and b[3]) for i, a in enumerate(mine) for j, b in enumerate(mine)]
    df = spark.createDataFrame(rows, "episode long, t int, ar boolean, ok boolean")
    assert sorted(tuple(r) for r in sequence.attention(df, "episode", "t", "ar", "ok", block).collect()) == sorted(want)


def test_mask_query_has_all_pairs(spark, events):
    got = catalog.queries()["attn_mask_block"](spark, events[0])
    assert {r.episode: (r["count"], r.i) for r in got.groupBy("episode").agg(F.count("*").alias("count"), F.max("i").alias("i")).collect()} == {1: (430 * 430, 429), 2: (49, 6), 3: (45 * 45, 44)}


def test_an_epoch_is_all_batches(spark):
    rows = spark.createDataFrame([(b, 10 * b + i) for b in range(7) for i in range(3)], "batch long, id long")
    got = sorted(tuple(r) for r in sampling.epochs(rows, "batch", None, 17).select("step", "id").collect())
    assert got == sorted((step, 10 * (step % 7) + i) for step in range(17) for i in range(3))


def test_epoch_query_goes_round_after_the_whole_table(spark, tmp_path):
    spark.range(7 * 200 + 50).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["epoch_cycle"](spark, str(tmp_path)).collect())
    assert got == [(step, step % 7 * 200 + i) for step in range(10) for i in range(200)]


def test_chunks_have_all_dimensions(spark, tmp_path):
    lines = [(7, n, n, n, 10.0 * n, 1.0 * n, 0.01 * n, 0.001 * n) for n in range(1, 7)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double")
    df.withColumn("l_shipdate", F.lit("2020-01-01").cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.t, r.k, r.dim, r.v) for r in catalog.queries()["chunk_clamp"](spark, str(tmp_path)).collect())
    assert got == [(t, k, d, pytest.approx(round((1, 10, 0.01, 0.001)[d] * (min(t + k, 5) + 1), 4))) for t in range(6) for k in range(4) for d in range(4)]
