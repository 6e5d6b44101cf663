"""Pictures as policies get them, step samples and suite limits, by literal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import images
from trajecta.operators import sampling, sequence

IMAGE = "struct<data:binary,h:int,w:int,c:int>"


def test_rounding_and_padding():
    """Doubling a row: outer pixels stay, inner ones are a quarter of the way. 0.5 and 2.5 go to the even number."""
    x = np.array([[[0], [2]]], np.uint8)
    assert images.with_pad_even(x, 2, 4)[0, :, 0].tolist() == [0, 0, 2, 2]
    assert images.with_pad(x, 2, 4)[0, :, 0].tolist() == [0, 1, 2, 2]
    ten = np.array([[[10], [20]]], np.uint8)
    assert images.with_pad_even(ten, 2, 4)[:, :, 0].tolist() == [[10, 12, 18, 20]] * 2
    tall = images.with_pad_even(np.full((4, 2, 1), 7, np.uint8), 4, 5)
    assert tall[0, :, 0].tolist() == [0, 7, 7, 0, 0]
    f = np.array([[[1.5], [-0.5]]], np.float32)
    assert images.with_pad_even(f, 2, 2)[:, :, 0].tolist() == [[1.0, -0.5], [-1.0, -1.0]]
    half = images.with_pad_even(np.array([[[0], [10], [20], [30]]], np.uint8).repeat(4, axis=0), 2, 2)[0, :, 0]
    assert half.tolist() == [7, 23]  # weights 3, 3, 1 and their mirror
    with pytest.raises(ValueError):
        images.with_pad_even(x.astype(np.float64), 1, 1)


def picture(v, h=2, w=2, c=3):
    return (bytes(np.arange(h * w * c, dtype=np.uint8) + v), h, w, c)


def test_cameras(spark):
    alpha = (bytes([1, 2, 3, 4]), 1, 1, 4)
    df = spark.createDataFrame([(1, {"22_left": alpha, "22_right": picture(0), "33_left": picture(9)}), (2, {}), (3, None)], f"id int, m map<string,{IMAGE}>")
    got = {r.id: r for r in df.select("id", images.picked(F.col("m"), "22").alias("x"), images.picked(F.col("m"), "44").alias("none"), images.resize_with_pad_even(F.try_element_at("m", F.lit("33_left")), 2, 2).alias("same")).collect()}
    assert bytes(got[1].x.data) == bytes([3, 2, 1]) and tuple(got[1].x)[1:] == (1, 1, 3)
    assert all(got[i].x.data is None for i in (2, 3)) and got[1].none.data is None and bytes(got[1].same.data) == picture(9)[0]


def test_observations(spark):
    df = spark.createDataFrame([(1, {"top": picture(0), "top_depth": picture(5)})], f"id int, m map<string,{IMAGE}>")
    out = df.select(images.observed(F.col("m"), ["top", "top_depth", "side"], 2, 2).alias("o")).first().o
    assert list(out) == ["top"] and tuple(out["top"])[1:] == (3, 2, 2)
    assert list(out["top"].data) == [0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11]


def test_step_samples(spark):
    df = spark.createDataFrame([(e, t, t % 3 > 0) for e, n in ((1, 40), (2, 2), (3, 9)) for t in range(n)], "e long, t long, moving boolean")
    every = sampling.trajectory_sample(df, "e", "t", 6).collect()
    assert {e: sum(r.e == e for r in every) for e in (1, 2, 3)} == {1: 6, 2: 2, 3: 6} and len({(r.e, r.t) for r in every}) == 14
    some = sampling.trajectory_sample(df, "e", "t", 6, "moving").collect()
    drawn = {(r.e, r.t) for r in sampling.trajectory_sample(df, "e", "t", 9).collect()}
    assert {(r.e, r.t) for r in some} <= drawn and all(r.moving for r in some)
    assert sum(r.e == 1 for r in some) == min(6, sum(e == 1 and t % 3 > 0 for e, t in drawn)) and sum(r.e == 3 for r in some) == 6


def test_suite_limits(spark):
    df = spark.createDataFrame([("libero_goal",), ("libero_10",)], "suite string")
    assert [r[0] for r in df.select(sequence.suite_limit(F.col("suite"))).collect()] == [310, 530]
    with pytest.raises(Exception, match="unknown task suite other"):
        spark.createDataFrame([("other",)], "suite string").select(sequence.suite_limit(F.col("suite"))).collect()
