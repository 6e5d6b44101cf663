"""Statistics of a configuration go into its transforms."""

import numpy as np

from trajecta.operators import adaptive, structure
from trajecta.plans import pipeline, statistics


def test_statistics_scale_the_configuration(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(2, 3, 8).tolist(), rng.normal(-1, 2, (5, 7)).tolist(), "go", "unused") for i in range(300)]
    frames = spark.createDataFrame(rows, "frame_id long, state array<double>, actions array<array<double>>, prompt string, other string").repartition(3)
    config = pipeline.config("flow_libero")
    found = statistics.config_statistics(config, frames, f"file://{tmp_path}/all")
    stats = statistics.norm_stats(found)
    state, actions = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    actions[:, :, :6] -= state[:, None, :6]
    assert np.allclose(stats["state"].mean, state.mean(axis=0)) and np.allclose(stats["actions"].std, actions.reshape(-1, 7).std(axis=0))
    low = np.quantile(actions.reshape(-1, 7), 0.01, axis=0, method="inverted_cdf")
    assert np.abs(np.array(stats["actions"].q01) - low).max() < 0.03
    assert {(r.field, r.n) for r in found.collect()} == {("state", 300), ("actions", 1500)}
    ready = frames.transform(config.training(stats)).select("state", "actions").collect()
    z = np.array([r.state for r in ready])[:, :8]
    assert np.allclose(z.mean(axis=0), 0, atol=1e-6) and np.allclose(z.std(axis=0), 1, atol=1e-3)
    few = statistics.config_statistics(config, frames, f"file://{tmp_path}/few", max_frames=("frame_id", 50))
    assert {(r.field, r.n) for r in few.collect()} == {("state", 50), ("actions", 250)}


def test_stored_records_without_images_being_read(spark, tmp_path):
    """The repack map names images; nothing but state and actions reaches the scan of a table."""
    image = (b"\x07" * 12, 2, 2, 3)
    rows = [(image, image, [float(i)] * 8, [[float(i)] * 7], "go") for i in range(4)]
    kind = "struct<data:binary,h:int,w:int,c:int>"
    spark.createDataFrame(rows, f"image {kind}, wrist_image {kind}, state array<double>, actions array<array<double>>, prompt string").write.parquet(f"{tmp_path}/set")
    frames = spark.read.parquet(f"{tmp_path}/set")
    found = statistics.config_statistics(pipeline.config("discrete_libero"), frames, f"file://{tmp_path}/st", stored=True)
    assert {(r.field, r.dim): r.max for r in found.collect()}["state", 7] == 3.0
    ready = frames.transform(lambda df: structure.compose(*pipeline.config("discrete_libero").data_group().inputs)(df))
    plan = adaptive.states(ready, {"state": "state", "actions": "actions"})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<state:array<double>,actions:array<array<double>>>" in plan
