"""Parameter files, annotations and ranges, resumed runs, and what a model wants of a record."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import vector
from trajecta.operators import lookup
from trajecta.plans import pipeline
from trajecta.sources import datasets


def test_parameter_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    np.savez(tmp_path / "a" / "one.npz", **{"enc/w/value": np.zeros((3, 4), np.float32), "enc/b/value": np.zeros(4), "step/value": np.int64(7)})
    read = lambda p: sorted((r.path, r.dtype, r.shape, r.bytes) for r in datasets.read_parameters(spark, f"file://{p}").collect())
    assert read(tmp_path / "a") == [("enc/b", "float64", [4], 32), ("enc/w", "float32", [3, 4], 48), ("step", "int64", [], 8)]
    np.savez_compressed(tmp_path / "a" / "two.npz", **{"head": np.zeros((2, 0), np.uint8)})
    assert [r[0] for r in read(tmp_path / "a")] == ["enc/b/value", "enc/w/value", "head", "step/value"]
    np.savez(tmp_path / "bad.npz", x=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="objects"):
        read(tmp_path / "bad.npz")


def test_annotations_ranges_and_resume(spark, tmp_path):
    (tmp_path / "notes.json").write_text(json.dumps({"a--1": {"language_instruction1": "open", "language_instruction2": "x"}, "b--2": {"language_instruction1": "close"}}))
    got = sorted(map(tuple, datasets.read_annotations(spark, f"file://{tmp_path}/notes.json").collect()))
    assert got == [("a--1", "open"), ("b--2", "close")]
    ranges = spark.createDataFrame([("a--1", 0, 5)], "episode string, start int, end int")
    datasets.append_ranges(ranges, f"file://{tmp_path}/ranges")
    todo = spark.createDataFrame([("a--1",), ("b--2",)], "episode string")
    left = lookup.unfinished(todo, spark.read.parquet(f"file://{tmp_path}/ranges"), "episode")
    assert [r.episode for r in left.collect()] == ["b--2"]
    datasets.append_ranges(ranges.withColumn("episode", F.lit("b--2")), f"file://{tmp_path}/ranges")
    done = spark.read.parquet(f"file://{tmp_path}/ranges")
    assert done.count() == 2 and lookup.unfinished(todo, done, "episode").count() == 0


def test_what_a_model_wants(spark):
    kind = "struct<data:binary>"
    rows = [({"base_0_rgb": (b"x",), "left_wrist_0_rgb": (b"x",), "right_wrist_0_rgb": (b"x",), "z": (b"x",)}, {"base_0_rgb": False})]
    df = spark.createDataFrame(rows, f"image map<string,{kind}>, image_mask map<string,boolean>")
    got = pipeline.observed()(df).first()
    assert sorted(got.image) == sorted(pipeline.SLOTS) and got.image_mask == {"base_0_rgb": False, "left_wrist_0_rgb": True, "right_wrist_0_rgb": True}
    assert all(pipeline.observed()(df.drop("image_mask")).first().image_mask.values())
    with pytest.raises(Exception, match="images are missing: side"):
        pipeline.observed([*pipeline.SLOTS, "side"])(df).collect()


def test_waves_of_places(spark):
    made = spark.range(1).select(vector.sincos_embedding_2d(F.lit(2), F.lit(3), 8)).first()[0]
    assert made == pytest.approx([np.sin(3), np.sin(3e-4), np.cos(3), np.cos(3e-4), np.sin(2), np.sin(2e-4), np.cos(2), np.cos(2e-4)])
    with pytest.raises(ValueError):
        vector.sincos_embedding_2d(F.lit(1), F.lit(1), 6)


def test_passing(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, passes_filter boolean")
    out = lookup.passing(df)
    assert out.columns == ["id"] and [r.id for r in out.collect()] == [1]
