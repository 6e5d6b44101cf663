"""Resizing, FAST decoding, restructuring of trajectories and assembly of two-arm vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import images, text, vector
from trajecta.operators import lookup
from trajecta.plans import pipeline

IMAGE = "struct<data:binary,h:int,w:int,c:int>"


def stats(**sizes):
    return {n: pipeline.NormStats([0.0] * d, [1.0] * d, [-1.0] * d, [1.0] * d) for n, d in sizes.items()}


@pytest.mark.parametrize("name", ["flow_libero", "discrete_libero", "fast_libero"])
def test_training_resizes_all_images(spark, name):
    x = np.random.default_rng(0).integers(0, 256, (30, 40, 3)).astype(np.uint8)
    row = ((x.tobytes(), 30, 40, 3), (x.tobytes(), 30, 40, 3), [0.1] * 8, "go")
    df = spark.createDataFrame([row], f"image {IMAGE}, wrist_image {IMAGE}, state array<double>, prompt string")
    got = df.transform(pipeline.config(name).training(stats(state=8))).first().image
    assert len(got) == 3 and {(v.h, v.w, len(v.data)) for v in got.values()} == {(224, 224, 224 * 224 * 3)}
    assert bytes(got["base_0_rgb"].data) == images.with_pad(x, 224, 224).tobytes()


def test_fast_outputs_are_decoded(spark):
    c = pipeline.config("fast_libero")
    h, d = c.model.horizon, c.model.dim
    wanted = [[(k * d + j) % 250 / 128 - 1 for j in range(d)] for k in range(h)]
    df = spark.createDataFrame([([0.0] * d, wanted, "go")], "state array<double>, actions array<array<double>>, prompt string")
    tokens = df.transform(pipeline.tokenized(pipeline.Model(c.model.family, h, d, 400))).select("state", F.col("tokenized_prompt").alias("actions"))
    back = pipeline.decoded(c.model)(tokens).first().actions
    assert back == wanted
    none = spark.createDataFrame([([0.0] * d, [5, 6, 7])], "state array<double>, actions array<int>")
    assert pipeline.decoded(c.model)(none).first().actions == [[0.0] * d] * h
    out = tokens.transform(c.inference_outputs(stats(actions=d))).first().actions
    assert np.allclose(out, wanted, atol=1e-5)


def test_action_tokens_end_at_the_bar(spark):
    f = lambda s: [ord(ch) + 3 for ch in s]
    df = spark.createDataFrame([(f("xAction: ") + [90, 91] + f("|zz|"),), (f("Action: ") + [90],), (f("Action: |"),), (f("none|"),), ([],)], "x array<int>")
    assert [r.y for r in df.select(text.action_tokens(F.col("x"), 1000).alias("y")).collect()] == [[871 - 90, 871 - 91], [871 - 90], [], None, None]


def test_restructured_trajectories(spark):
    rows = [("f", f"e{e}", t, ([1.0 * t] * 7, [2.0 * t] * 7, [0.5]), (f"one{e}", f"two{e}", "wrist", [3.0], [4.0]), "a", "b", "c") for e in range(40) for t in range(3)]
    schema = "recording_folderpath string, file_path string, t int, action_dict struct<joint_position:array<double>,joint_velocity:array<double>,gripper_position:array<double>>, observation struct<exterior_image_1_left:string,exterior_image_2_left:string,wrist_image_left:string,joint_position:array<double>,gripper_position:array<double>>, language_instruction string, language_instruction_2 string, language_instruction_3 string"
    df = spark.createDataFrame(rows, schema)
    ranges = spark.createDataFrame([("f--e1", 1, 3)], "episode string, start int, end int")
    got = lookup.restructured(df, ranges).collect()
    assert len(got) == 120 and {r.step_id for r in got} == {f"f--e{e}--{t}" for e in range(40) for t in range(3)}
    assert all(r.actions == [1.0 * r.t] * 7 + [0.5] for r in got)
    assert {r.step_id for r in got if r.passes_filter} == {"f--e1--1", "f--e1--2"}
    choices = {(r.episode, r.observation.image, r.prompt) for r in got}
    assert len(choices) == 40 and {c[1][:3] for c in choices} == {"one", "two"} and {c[2] for c in choices} == {"a", "b", "c"}
    assert all(r.actions == [2.0 * r.t] * 7 + [0.5] and r.passes_filter for r in lookup.restructured(df, joint_position=False).collect())


def test_two_arm_vectors(spark):
    left, right = [float(i) for i in range(9)], [10.0 + i for i in range(9)]
    df = spark.createDataFrame([(left, right)], "l array<double>, r array<double>")
    got = df.select(*(f("l", "r").alias(n) for n, f in (("p", lambda a, b: vector.two_arm_position(F.col(a), F.col(b))), ("v", lambda a, b: vector.two_arm_velocity(F.col(a), F.col(b))), ("e", lambda a, b: vector.two_arm_effort(F.col(a), F.col(b))), ("a", lambda a, b: vector.two_arm_action(F.col(a), F.col(b)))))).first()
    arms = lambda f, k: [*left[:6], f(left[k]), *right[:6], f(right[k])]
    assert got.p == pytest.approx(arms(lambda v: (v - 0.01844) / (0.05800 - 0.01844), 7))
    assert got.v == pytest.approx(arms(lambda v: v / (0.05800 - 0.01844), 7))
    assert got.e == left[:7] + right[:7]
    assert got.a == pytest.approx(arms(lambda v: (v + 0.6842) / (0.3083 + 0.6842), 6))


def test_bicubic(spark):
    x = np.random.default_rng(1).integers(0, 256, (9, 16, 3)).astype(np.uint8)
    assert (images.bicubic(x, 9, 16) == x).all()
    assert (images.bicubic(np.full((37, 50, 3), 201, np.uint8), 180, 320) == 201).all()
    # Twice as wide: the taps at a quarter's distance, by hand.
    row = np.array([0, 0, 100, 200, 200, 200], np.uint8)[None, :, None].repeat(3, 2)
    w = lambda d: (1.5 * d - 2.5) * d * d + 1 if d < 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2
    value = sum(w(abs(j - 2.25)) * v for j, v in enumerate([0, 0, 100, 200]) if 0 < j) + w(1.75) * 200
    assert images.bicubic(row, 1, 12)[0, 5, 0] == int(value + 0.5)
    got = spark.createDataFrame([((x.tobytes(), 9, 16, 3),)], f"i {IMAGE}").select(images.recorded(F.col("i")).alias("y")).first().y
    assert (got.h, got.w) == (180, 320) and bytes(got.data) == images.bicubic(x[..., ::-1], 180, 320).tobytes()
