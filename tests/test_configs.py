"""The robots' configurations against the matrix they are made from."""

import json

import pytest

from trajecta.plans import pipeline


@pytest.mark.parametrize(
    "name, horizon, dim, tokens, delta, tokenizer",
    [
        ("discrete_droid_jointpos_polaris", 15, 32, 200, (7, -1), None),
        ("fast_droid_jointpos_polaris", 10, 8, 180, (7, -1), None),
        ("flow_droid_jointpos_polaris", 10, 32, 100, (7, -1), None),
        ("flow_droid_jointpos_100k_polaris", 10, 32, 100, (7, -1), None),
        ("fast_binning_droid", 15, 8, 400, None, "binning"),
        ("fast_universal_droid", 15, 8, 250, None, None),
        ("fast_specialist_droid", 15, 8, 250, None, "fast_droid_specialist"),
        ("fast_vq_droid", 15, 8, 250, None, "fsq"),
        ("flow_diffusion_droid", 10, 8, 48, None, None),
    ],
)
def test_droid_configs(name, horizon, dim, tokens, delta, tokenizer):
    c = pipeline.config(name)
    assert (c.robot, c.model.horizon, c.model.dim, c.model.tokens, c.delta, c.model.tokenizer) == ("droid", horizon, dim, tokens, delta, tokenizer)
    assert [(s.name, s.weight) for s in c.sources] == ([("droid", 0.9), ("polaris_droid_cotrain_dataset", 0.1)] if "polaris" in name else [])
    assert all(s.filtered for s in c.sources)


def test_a_mix_filters_each_dataset_by_its_own_ranges(spark, tmp_path):
    c = pipeline.config("flow_droid_jointpos_polaris")
    frames = spark.createDataFrame([(1, t, t) for t in range(4000)], "episode int, t int, id long")
    ranges = lambda a, b: spark.createDataFrame([(1, a, b)], "episode int, start int, end int")
    main, other = (s.name for s in c.sources)
    got = [(r["source"], r.t) for r in c.mixed({main: frames, other: frames}, {main: ranges(0, 2000), other: ranges(2000, 4000)}, "id").collect()]
    assert sorted(t for n, t in got if n == main) == list(range(2000))
    few = [t for n, t in got if n == other]
    assert all(t >= 2000 for t in few) and 0.08 < len(few) / 2000 < 0.145
    with pytest.raises(ValueError, match="polaris"):
        c.mixed({main: frames}, {main: ranges(0, 1)}, "id")
    for s, r in zip(c.sources, ([[0, 2000]], [[2000, 4000]])):
        path = tmp_path / s.name / f"{s.version}.json"
        path.parent.mkdir()
        path.write_text(json.dumps({"1": r}))
    again = c.mixed({main: frames, other: frames}, f"file://{tmp_path}", "id").collect()
    assert sorted((r["source"], r.t) for r in again) == sorted(got)


def stats(*sizes):
    return {n: pipeline.NormStats([0.0] * d, [1.0] * d, [-1.0] * d, [1.0] * d) for n, d in zip(("state", "actions"), sizes)}


def said(row):
    """The prompt's text, without BOS and the newline token at its end."""
    tokens = [t for t, there in zip(row.tokenized_prompt, row.tokenized_prompt_mask) if there][1:]
    return "".join(chr(t - 3) for t in (tokens[:-1] if tokens[-1] == 108 else tokens))


IMAGE = "struct<data:binary,h:int,w:int,c:int>"


def test_stored_records_and_default_prompts(spark):
    image = (bytes([7]) * 12, 2, 2, 3)
    cameras = ("cam_high", "cam_left_wrist", "cam_right_wrist")
    df = spark.createDataFrame([(image, image, image, [0.1] * 14, [[0.2] * 14])], ", ".join([*(f"`observation.images.{c}` {IMAGE}" for c in cameras), "`observation.state` array<double>", "action array<array<double>>"]))
    got = df.transform(pipeline.config("flow_aloha_pen_uncap").training_from_dataset(stats(14, 14))).first()
    assert said(got) == "uncap the pen" and all(got.image_mask.values()) and len(got.state) == 32
    made = spark.createDataFrame([((image, image, [0.1] * 7, 0.5), [[0.2] * 8], "Pick_up")], f"observation struct<image:{IMAGE},wrist_image:{IMAGE},joint_position:array<double>,gripper_position:double>, actions array<array<double>>, prompt string")
    got = made.transform(pipeline.config("discrete_droid_jointpos_polaris").training_from_dataset(stats(8, 8))).first()
    assert said(got).startswith("Task: Pick up, State: ") and got.image_mask["left_wrist_0_rgb"]
    prompts = {n: c.default_prompt for n, c in pipeline.CONFIGS.items() if c.default_prompt}
    assert prompts["flow_aloha_towel"] == "fold the towel" and prompts["flow_aloha_sim"] == "Transfer cube" and len(prompts) == 5


def test_continuous_state_is_not_in_the_prompt(spark):
    df = spark.createDataFrame([([0.1] * 8, "Pick_up")], "state array<double>, prompt string")
    assert said(df.transform(pipeline.config("discrete_libero").training(stats(8, 7))).first()) == "Pick up"
    assert said(df.transform(pipeline.tokenized(pipeline.Model(pipeline.Family.FLOW_DISCRETE, 1, 8, 200))).first()).startswith("Task: ")


def test_deltas_of_outputs_alone(spark):
    """One configuration's records hold deltas already: they are made absolute on the way out, and left alone on the way in."""
    group = pipeline.config("fast_binning_droid_jointpos").data_group()
    df = spark.createDataFrame([([1.0] * 7, 0.5, [[0.25] * 8])], "joint_position array<double>, gripper_position double, actions array<array<double>>")
    inside = pipeline.structure.compose(*group.inputs)(df)
    assert inside.first().actions == [[0.25] * 8]
    assert pipeline.structure.compose(*group.outputs)(inside).first().actions == [[1.25] * 7 + [0.25]]
    both = pipeline.config("fast_droid_jointpos_polaris").data_group()
    assert pipeline.structure.compose(*both.inputs)(df).first().actions == [[-0.75] * 7 + [0.25]]


def test_unknown_cameras_are_an_error(spark):
    df = spark.createDataFrame([([0.0] * 14, b"")], "state array<double>, cam_ceiling binary")
    with pytest.raises(ValueError, match="cam_ceiling"):
        pipeline.structure.compose(*pipeline.config("flow_aloha").data_group().inputs)(df)
