"""Chunks by time against a plain version: jitter, gaps, ties, nulls, long episodes over many buckets."""

import random

import pytest
from pyspark.sql import functions as F

from trajecta.operators import timed
from trajecta.sources import datasets

FPS, H, TOL = 10.0, 4, 1e-3


def plainly(rows, miss):
    """{row id: (values, pads, missing)} by looking at all frames of the episode for each element."""
    out = {}
    for i, e, t, v in rows:
        mine = [(r[2], r[3]) for r in rows if r[1] == e and r[2] is not None]
        got = []
        for k in range(H):
            if t is None:
                got.append((None, False, True))
                continue
            q = t + k / FPS
            near = sorted((abs(x - q), x, w) for x, w in mine if abs(x - q) <= TOL)
            end = max(x for x, _ in mine)
            if near:
                got.append((near[0][2], False, False))
            elif q > end + TOL:
                got.append((max(mine)[1], True, False))
            else:
                got.append((max(m for m in mine if m[0] <= q + TOL)[1] if miss == "hold" else None, False, True))
        out[i] = tuple(zip(*got))
    return out


def recorded():
    rng = random.Random(11)
    rows = []
    for e in (1, 2, None):
        t = 0.0
        for _ in range({1: 400, 2: 25}.get(e, 12)):
            rows.append((len(rows), e, round(t + rng.choice([0, 0, 4e-4, -4e-4, 2e-3]), 6), rng.random()))
            t += 0.1 * rng.choice([1, 1, 1, 1, 1, 2, 30])
    rows += [(len(rows) + i, 1, None, 0.5) for i in range(2)]
    rows += [(len(rows), 7, 3.0, 1.5)]
    return rows + [(len(rows), 2, rows[405][2], -1.0), (len(rows) + 1, 2, rows[405][2], -1.0)]


@pytest.mark.parametrize("miss, bucket", [("null", 4096), ("null", 1), ("hold", 16)])
def test_equal_to_the_plain_version(spark, miss, bucket):
    rows = recorded()
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "id int, e int, ts double, v double, _t string, is_pad boolean").repartition(4)
    got = timed.time_chunks(df, {"v": "v", "again": "v"}, "e", "ts", H, FPS, TOL, miss, bucket)
    assert got.columns == ["id", "e", "ts", "_t", "v", "again", "is_pad", "is_missing"]
    found = {r.id: (tuple(r.v), tuple(r.is_pad), tuple(r.is_missing)) for r in got.collect()}
    want = plainly(rows, miss)
    assert found == {i: w for i, w in want.items()} and any(any(w[2]) for w in want.values())
    assert got.where("v = again").count() + got.where("exists(v, x -> x is null)").count() >= len(rows)


def test_a_miss_is_an_error(spark):
    frames = lambda *times: spark.createDataFrame([("a", t, [t]) for t in times], "e string, ts double, a array<double>")
    good = timed.time_chunks(frames(0.0, 0.10005, 0.2), {"a": "a"}, "e", "ts", 3, 10)
    assert good.columns == ["e", "ts", "a", "is_pad"]
    assert {r.ts: (r.a, r.is_pad) for r in good.collect()}[0.10005] == ([[0.10005], [0.2], [0.2]], [False, False, True])
    with pytest.raises(Exception, match="no frame within the tolerance of time 0.1 in episode a"):
        timed.time_chunks(frames(0.0, 0.2, 0.3), {"a": "a"}, "e", "ts", 3, 10).collect()
    with pytest.raises(Exception, match="tolerance"):
        timed.time_chunks(frames(0.0, 0.1002, 0.2), {"a": "a"}, "e", "ts", 2, 10).collect()
    with pytest.raises(ValueError, match="miss"):
        timed.time_chunks(frames(0.0), {"a": "a"}, "e", "ts", 3, 10, miss="skip")
    assert timed.time_chunks(frames(0.0).where("false"), {"a": "a"}, "e", "ts", 3, 10).collect() == []


def test_a_long_episode_is_many_groups(spark):
    """No window holds a whole episode."""
    df = spark.range(5000).select(F.lit(1).alias("e"), (F.col("id") / 10).alias("ts"), "id")
    got = timed.time_chunks(df, {"next": "id"}, "e", "ts", 3, 10, bucket=50)
    assert sorted(r.next for r in got.collect()) == [[min(i + k, 4999) for k in range(3)] for i in range(5000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan[plan.index("Window") : plan.index("Window") + 600]


def test_out_of_sync(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.1), (1, 0.25), (1, None), (2, 5.0)], "e int, ts double")
    assert sorted((r.ts or -1, r.step) for r in timed.out_of_sync(df, "e", "ts", 10).collect()) == [(-1, None), (0.25, pytest.approx(0.15))]


def test_dataset_with_chunks_and_prompts(spark, tmp_path):
    frames = spark.createDataFrame([(e, t, t / 5, [float(t)], e % 2) for e in range(3) for t in range(4)], "episode_index long, frame_index long, timestamp double, actions array<double>, task_index long")
    tasks = spark.createDataFrame([(0, "open"), (1, "close")], "task_index long, task string")
    datasets.write_episodes(frames, f"file://{tmp_path}/set", 5, tasks)
    got = datasets.training_frames(spark, f"file://{tmp_path}/set", 2, prompt_from_task=True).collect()
    assert sorted((r.episode_index, r.frame_index, r.actions, r.is_pad, r.prompt) for r in got) == [(e, t, [[float(t)], [float(min(t + 1, 3))]], [False, t == 3], "close" if e % 2 else "open") for e in range(3) for t in range(4)]
    with pytest.raises(Exception, match="tolerance"):
        datasets.write_episodes(frames.where("frame_index <> 1"), f"file://{tmp_path}/gap", 5, tasks)
        datasets.training_frames(spark, f"file://{tmp_path}/gap", 2).collect()
