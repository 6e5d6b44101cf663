"""Literal cases of structure, sequences, lookups, sampling, statistics, sources, pipelines and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import aggregates, lookup, sampling, sequence, stats, structure
from trajecta.plans import pipeline
from trajecta.sources import datasets
from trajecta.streaming import replay


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame([((1, 2), (3,))], "a struct<b:int,c:int>, b struct<c:int>")


def test_repack(nested):
    got = structure.repack(nested, {"a": {"b": "a/c"}, "d": "b/c"}).first()
    assert (got.a.b, got.d) == (2, 3)
    with pytest.raises(Exception, match="UNRESOLVED|cannot be resolved"):
        structure.repack(nested, {"x": "nothing"}).collect()


def test_rename(nested):
    assert structure.paths(structure.rename(nested, {"a/b": "x/y", "a/c": None}).schema) == ["x/y", "b/c"]
    assert structure.paths(structure.rename(nested, {"a": None}).schema) == ["a/b", "a/c", "b/c"]
    assert structure.paths(structure.rename(nested, {"a.+": None}).schema) == ["b/c"]
    assert structure.paths(structure.rename(nested, {"(.+)/c": r"\1/d"}).schema) == ["a/b", "a/d", "b/d"]
    with pytest.raises(ValueError, match="already exists"):
        structure.rename(nested, {"a/b": "a/c"})
    with pytest.raises(ValueError, match="leaf and a node"):
        structure.rename(nested, {"a/b": "b"})


def test_flatten_round_trip(nested):
    assert structure.unflatten(structure.flatten(nested)).first() == nested.first()
    assert structure.describe(nested.schema) == ["a/b: int", "a/c: int", "b/c: int"]


def test_defaults_and_checks(spark, nested):
    assert structure.default_column(spark.range(1), "prompt", "x").first().prompt == "x"
    with_null = spark.createDataFrame([(None,)], "prompt string")
    assert structure.default_column(with_null, "prompt", "x").first().prompt is None
    with pytest.raises(ValueError):
        structure.keyed_map(nested, {"z": 1}, lambda c, k: c, strict=True)
    with pytest.raises(Exception, match="are wanted"):
        structure.checked(spark.createDataFrame([([1, 2],)], "v array<int>"), {"v": 3}).collect()


def frames(spark, values, episode=1):
    return spark.createDataFrame([(episode, t, v) for t, v in enumerate(values)], "episode int, t int, v double")


def test_chunk_clamp(spark):
    got = [r.c for r in frames(spark, [0.0, 1.0, 2.0]).select("t", sequence.chunk(F.col("v"), "episode", "t", 4).alias("c")).orderBy("t").collect()]
    assert got == [[0, 1, 2, 2], [1, 2, 2, 2], [2, 2, 2, 2]]


def test_idle_ranges(spark):
    values = [float(t) for t in range(20)] + [19.0] * 10 + [float(t) for t in range(50, 60)]
    df = frames(spark, values).withColumn("idle", sequence.idle(F.array("v"), "episode", "t"))
    assert [r.t for r in df.where("idle").orderBy("t").collect()] == list(range(20, 30))
    assert [tuple(r) for r in sequence.keep_ranges(df, "idle", "episode", "t").collect()] == [(1, 0, 10)]


def test_islands_cover_timeline(spark):
    rng = np.random.default_rng(0)
    flags = rng.integers(0, 2, 200).tolist()
    df = spark.createDataFrame([(1, t, bool(f)) for t, f in enumerate(flags)], "episode int, t int, f boolean")
    runs = sorted((r.start, r.end, r.f) for r in sequence.islands(df, "f", "episode", "t").collect())
    assert [f for a, b, f in runs for _ in range(b - a)] == [bool(f) for f in flags]


def test_frame_filter(spark):
    df = spark.createDataFrame([(1, t) for t in (99, 100, 200, 300)] + [(2, 5)], "episode int, t int")
    ranges = spark.createDataFrame([(1, 0, 100), (1, 200, 300)], "episode int, start int, end int")
    assert sorted(tuple(r) for r in lookup.frame_filter(df, ranges, "episode", "t").collect()) == [(1, 99), (1, 200)]
    assert lookup.frame_filter(df, None, "episode", "t").count() == 5
    flags = {(r.episode, r.t): r.passes_filter for r in lookup.frame_flags(df, ranges, "episode", "t").collect()}
    assert flags == {(1, 99): True, (1, 100): False, (1, 200): True, (1, 300): False, (2, 5): False}


def test_task_lookup(spark):
    tasks = spark.createDataFrame([(1, "Hello, world!")], "task_index int, task string")
    good = lookup.required(spark.createDataFrame([(1,)], "i int"), tasks.withColumnRenamed("task_index", "i"), "i", "task", "prompt")
    assert good.first().prompt == "Hello, world!"
    with pytest.raises(Exception, match="not found"):
        lookup.required(spark.createDataFrame([(2,)], "i int"), tasks.withColumnRenamed("task_index", "i"), "i", "task", "prompt").collect()


def test_batches(spark):
    rows = sampling.positioned(spark.range(10).toDF("id"), "id", 3)
    assert sorted(r.position for r in rows.collect()) == list(range(10))
    got = sampling.batches(rows, "position", 4)
    assert got.count() == 8
    assert sampling.epochs(got, "batch_id", 2, 5).groupBy("step").count().where("count = 4").count() == 5
    with pytest.raises(ValueError):
        sampling.batches(rows, "position", 11)
    shards = [sampling.sharded(rows, "position", r, 3).count() for r in range(3)]
    assert shards == [3, 3, 3]


def test_mixing(spark):
    a, b = spark.range(4000).toDF("id"), spark.range(4000).toDF("id")
    got = {r["source"]: r["count"] for r in sampling.mixed({"a": (a, 0.9), "b": (b, 0.1)}, "id", 1).groupBy("source").count().collect()}
    assert got["a"] == 4000 and 0.08 < got["b"] / 4000 < 0.145
    with pytest.raises(ValueError):
        sampling.mixed({"a": (a, 0.7), "b": (b, 0.2)}, "id")


def test_statistics(spark):
    df = spark.createDataFrame([([float(3 * i + j) for j in range(3)],) for i in range(4)], "v array<double>")
    got = {r.dim: r for r in stats.moments(stats.elements(df, F.col("v"), "v")).collect()}
    x = np.arange(12).reshape(4, 3)
    assert [got[i]["mean"] for i in range(3)] == x.mean(0).tolist()
    assert [got[i]["std"] for i in range(3)] == pytest.approx(x.std(0))
    found = stats.collected(stats.norm_stats(stats.elements(df, F.col("v"), "v")))
    assert stats.from_json(stats.to_json(found)) == found
    assert list(json.loads(stats.to_json(found))["norm_stats"]["v"]) == ["mean", "std", "q01", "q99"]


def test_quantiles_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([([float(v)],) for v in rng.normal(size=3000)], "v array<double>")
    q = lambda d: tuple(stats.histogram_quantiles(stats.elements(d, F.col("v"), "v"), {"q01": 0.01, "q99": 0.99}).first())
    assert q(df.repartition(7)) == q(df.coalesce(1))
    assert q(df)[2] == pytest.approx(-2.326, abs=0.25)


def test_constant_vector(spark):
    df = spark.createDataFrame([([5.0],)] * 3, "v array<double>")
    assert tuple(stats.histogram_quantiles(stats.elements(df, F.col("v"), "v"), {"q": 0.5}).first()) == ("v", 0, 5.0)


def test_summaries(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(5)], "k int, t int, v double")
    assert aggregates.moving_average(df, "k", "t", "v", 0.5).first().ema == pytest.approx(3.0625)
    assert [tuple(r) for r in aggregates.interval_means(df, "t", 2, "v").orderBy("window").collect()] == [(0, 0.0), (1, 1.5), (2, 3.5)]
    assert aggregates.next_index(df.where("t < 0"), "t").first().next == 0


def test_episode_files(spark, tmp_path):
    df = spark.createDataFrame([(e, f, [float(f)]) for e in range(3) for f in range(4)], "episode_index long, frame_index long, state array<double>")
    tasks = spark.createDataFrame([(0, "pick")], "task_index long, task string")
    datasets.write_episodes(df, f"file://{tmp_path}/set", 15.0, tasks)
    got, names, info = datasets.read_episodes(spark, f"file://{tmp_path}/set")
    assert got.drop("chunk").count() == 12 and names.first().task == "pick" and info["fps"] == 15.0
    made = {"state": stats.NormStats([1.0], [2.0], [0.0], [3.0])}
    datasets.write_stats(spark, f"file://{tmp_path}/stats", made)
    assert datasets.read_stats(spark, f"file://{tmp_path}/stats") == made
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        datasets.read_stats(spark, f"file://{tmp_path}/none")
    (tmp_path / "keep.json").write_text('{"e1": [[0, 10], [20, 30]], "e2": []}')
    assert sorted(tuple(r) for r in datasets.read_ranges(spark, f"file://{tmp_path}/keep.json").collect()) == [("e1", 0, 10), ("e1", 20, 30)]
    assert [r.name for r in datasets.files(spark, f"file://{tmp_path}", "*.json").collect() if r.name == "keep.json"] == ["keep.json"]


def test_synthetic_rows_repeat(spark):
    make = lambda n: datasets.synthetic(spark, n, {"x": ("float", 2), "i": ("int", 2), "z": ("other", 1)}).collect()
    assert make(5) == make(10)[:5]
    assert all(-1 <= v < 1 for r in make(50) for v in r.x) and all(0 <= v < 2048 for r in make(50) for v in r.i)


def test_group_order():
    f, g, h = (lambda d: d), (lambda d: d), (lambda d: d)
    group = pipeline.Group((f,), (f,)).push([g], [h])
    assert group.inputs == (f, g) and group.outputs == (h, f)


def test_config_names():
    assert pipeline.config("flow_droid").robot == "droid"
    with pytest.raises(ValueError, match="did you mean flow_droid"):
        pipeline.config("flow_droit")
    with pytest.raises(ValueError):
        pipeline.check_cameras(["cam_high", "other"])


@pytest.mark.parametrize("name", sorted(n for n, c in pipeline.CONFIGS.items() if c.robot))
def test_training_pipelines(spark, name):
    c = pipeline.config(name)
    robot = pipeline.ROBOTS[c.robot]
    dims = {"aloha": 14, "droid": 8, "libero": 8, "yam": 14}[c.robot]
    image = (bytes(12), 2, 2, 3)
    row, kinds = [1, 0], ["episode int", "t int"]
    for part in robot.state:
        row.append([0.1] * dims if len(robot.state) == 1 else [0.1] * 7 if part == "joint_position" else 0.5)
        kinds.append(f"{part} {'double' if part == 'gripper_position' else 'array<double>'}")
    for camera in dict.fromkeys(x for x in robot.cameras.values() if x):
        row.append(image)
        kinds.append(f"{camera} struct<data:binary,h:int,w:int,c:int>")
    steps = max(robot.out, 8)
    row += [[[0.2] * steps] * 2 if c.robot in ("droid", "libero") else [[0.2] * 14] * 2, "Pick_up"]
    df = spark.createDataFrame([tuple(row)], ", ".join([*kinds, "actions array<array<double>>", "prompt string"]))
    n = lambda d: pipeline.NormStats([0.0] * d, [1.0] * d, [-1.0] * d, [1.0] * d)
    got = df.transform(c.training({"state": n(dims), "actions": n(steps)})).first()
    assert len(got.tokenized_prompt) == len(got.tokenized_prompt_mask) == c.model.tokens
    assert len(got.image) == 3 and set(got.image) == set(got.image_mask)
    if c.model.family is pipeline.Family.FAST:
        assert len(got.token_loss_mask) == c.model.tokens
    else:
        assert len(got.state) == c.model.dim and len(got.actions[0]) == c.model.dim
        out = spark.createDataFrame([([0.0] * 32, [[0.1] * 32])], "state array<double>, actions array<array<double>>")
        assert len(out.transform(c.inference_outputs({"actions": n(steps)})).first().actions[0]) == robot.out


def test_deltas_are_undone_before_the_slice(spark):
    df = spark.createDataFrame([([1.0] * 14, [[5.0] * 14])], "state array<double>, actions array<array<double>>")
    moved = df.transform(pipeline.deltas([True] * 6 + [False]))
    assert moved.first().actions[0][:7] == [4.0] * 6 + [5.0]
    assert moved.transform(pipeline.deltas([True] * 6 + [False], absolute=True)).first() == df.first()


def test_stream_replay_keeps_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, [float(t), t + 0.5, t + 0.75]) for t in range(7)], "episode long, t int, chunk array<double>")
    got = sorted((r.t, r["query"], r.place, r.action) for r in replay.run_bounded(rows, lambda s: replay.chunk_replay(s, 3)).collect())
    assert got == [(t, t // 3 * 3, t % 3, t // 3 * 3 + (0.0, 0.5, 0.75)[t % 3]) for t in range(7)]


def test_stream_lifecycle(spark):
    rows = spark.createDataFrame([(1, t, False) for t in range(9)] + [(2, t, t == 1) for t in range(9)], "episode long, t int, complete boolean")
    got = replay.run_bounded(rows, lambda s: replay.lifecycle(s, 3)).groupBy("episode").count().collect()
    assert {r.episode: r["count"] for r in got} == {1: 4, 2: 2}
