"""Declarative pipelines: groups of transforms, and the robots' configurations as data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions import text, vector
from trajecta.functions.images import resize_with_pad, zero_image
from trajecta.operators import lookup, sampling, structure
from trajecta.operators.stats import NormStats
from trajecta.operators.structure import Transform
from trajecta.sources import datasets


@dataclass(frozen=True)
class Group:
    """Transforms on the way in and on the way out."""

    inputs: tuple[Transform, ...] = ()
    outputs: tuple[Transform, ...] = ()

    def push(self, inputs: Sequence[Transform] = (), outputs: Sequence[Transform] = ()) -> Group:
        """Inputs go to the end, outputs to the front."""
        return Group((*self.inputs, *inputs), (*outputs, *self.outputs))


class Family(Enum):
    FLOW = "flow"
    FLOW_DISCRETE = "flow_discrete"
    FAST = "fast"


@dataclass(frozen=True)
class Model:
    """Horizon H, dimension D, tokens L; discrete_state: whether FLOW_DISCRETE writes the state into the prompt; tokenizer: of the actions, where it is not the family's."""

    family: Family
    horizon: int
    dim: int
    tokens: int
    discrete_state: bool = True
    tokenizer: str | None = None


@dataclass(frozen=True)
class Source:
    """A recorded dataset of a mix: its weight, and whether keep ranges filter its frames."""

    name: str
    version: str
    weight: float
    filtered: bool = True

    def ranges_file(self, folder: str) -> str:
        """Where the dataset's keep ranges are below the folder that holds those of all datasets."""
        return f"{folder.rstrip('/')}/{self.name}/{self.version}.json"


@dataclass(frozen=True)
class Robot:
    """What differs between robots: the state's parts, the cameras by slot (None: a zero image), and how many action dimensions come out.

    masked: slots without a camera count as present (the FAST family)."""

    state: tuple[str, ...]
    cameras: dict[str, str | None]
    out: int
    fast_cameras: dict[str, str | None] | None = None
    joint_convention: bool = False
    masked: bool = True


# Camera slots and action sizes by robot.
ROBOTS = {
    "aloha": Robot(("state",), {"base_0_rgb": "cam_high", "left_wrist_0_rgb": "cam_left_wrist", "right_wrist_0_rgb": "cam_right_wrist"}, 14, joint_convention=True, masked=False),
    "droid": Robot(("joint_position", "gripper_position"), {"base_0_rgb": "exterior_image_1_left", "left_wrist_0_rgb": "wrist_image_left", "right_wrist_0_rgb": None}, 8, {"base_0_rgb": "exterior_image_1_left", "base_1_rgb": None, "wrist_0_rgb": "wrist_image_left"}),
    "libero": Robot(("state",), {"base_0_rgb": "image", "left_wrist_0_rgb": "wrist_image", "right_wrist_0_rgb": None}, 7),
    "yam": Robot(("state",), {"base_0_rgb": "top_image", "left_wrist_0_rgb": "left_wrist_image", "right_wrist_0_rgb": "right_wrist_image"}, 14),
    "ur5": Robot(("joints", "gripper"), {"base_0_rgb": "base_rgb", "left_wrist_0_rgb": "wrist_rgb", "right_wrist_0_rgb": None}, 7),
}
VOCABULARY = 257_152
ALOHA_CAMERAS = ("cam_high", "cam_low", "cam_left_wrist", "cam_right_wrist")


def as_vector(df: DataFrame, name: str) -> Column:
    """A column as a vector; a scalar becomes one of size 1."""
    return F.col(name) if structure.is_vector(df.schema, name) else F.array(F.col(name).cast("double"))


def robot_inputs(robot: Robot, model: Model) -> Transform:
    """state, image and image_mask by slot, actions and prompt of a robot's record."""

    def run(df: DataFrame) -> DataFrame:
        if robot.joint_convention:
            check_cameras([c for c in df.columns if c.startswith("cam_")])
        fast = model.family is Family.FAST
        slots = robot.fast_cameras if fast and robot.fast_cameras else robot.cameras
        state = F.concat(*(as_vector(df, c) for c in robot.state))
        images, masks = [], []
        for slot, camera in slots.items():
            there = camera is not None and camera in df.columns
            image = F.col(camera) if there else F.lit(None)
            images += [F.lit(slot), F.coalesce(image, zero_image()) if there else zero_image()]
            masks += [F.lit(slot), F.coalesce(image.isNotNull(), F.lit(False)) if there and not (fast and robot.masked) else F.lit(there or fast and robot.masked)]
        out = {"state": vector.decode_state(state) if robot.joint_convention else state, "image": F.create_map(*images), "image_mask": F.create_map(*masks)}
        if "actions" in df.columns:
            steps = F.col("actions")
            out["actions"] = F.transform(steps, lambda a: vector.encode_actions_inverse(a)) if robot.joint_convention else steps
        if "prompt" in df.columns:
            binary = df.schema["prompt"].dataType.simpleString() == "binary"
            out["prompt"] = F.decode("prompt", F.lit("UTF-8")) if binary else F.col("prompt")
        keys = [c for c in df.columns if c.endswith("_id") or c in ("episode", "t")]
        return df.select(*keys, *(v.alias(k) for k, v in out.items()))

    return run


def robot_outputs(robot: Robot) -> Transform:
    """The robot's dimensions of each action, in its own convention."""

    def run(df: DataFrame) -> DataFrame:
        step = (lambda a: vector.encode_actions(vector.head(a, robot.out))) if robot.joint_convention else (lambda a: vector.head(a, robot.out))
        return df.withColumn("actions", F.transform("actions", step))

    return run


def check_cameras(given: Sequence[str], expected: Sequence[str] = ALOHA_CAMERAS) -> None:
    if extra := set(given) - set(expected):
        raise ValueError(f"unexpected cameras: {sorted(extra)}")


def scaled(stats: dict[str, NormStats], quantile: bool, inverse: bool = False) -> Transform:
    """state and actions (where the table has them) scaled by their statistics."""
    if quantile and any(s.q01 is None or s.q99 is None for s in stats.values()):
        raise ValueError("quantile scaling needs q01 and q99")

    def run(df: DataFrame) -> DataFrame:
        new = {}
        for name, s in stats.items():
            if name in df.columns:
                a, b = (vector.literal(v) for v in ((s.q01, s.q99) if quantile else (s.mean, s.std)))
                body = {(False, False): vector.normalize_z, (True, False): vector.normalize_quantile, (False, True): vector.unnormalize_z, (True, True): vector.unnormalize_quantile}[quantile, inverse]
                deep = df.schema[name].dataType.simpleString().startswith("array<array")
                new[name] = _each(name, body, a, b) if deep else body(F.col(name), a, b)
        return df.withColumns(new) if new else df

    return run


def _each(name: str, body, a: Column, b: Column) -> Column:
    return F.transform(name, lambda x: body(x, a, b))


def deltas(mask: Sequence[bool] | None, absolute: bool = False) -> Transform:
    """Actions relative to the state (or back); a table without actions is unchanged."""
    body = vector.absolute_actions if absolute else vector.delta_actions
    return lambda df: df if mask is None or "actions" not in df.columns else df.withColumn("actions", body(F.col("actions"), F.col("state"), mask))


def tokenized(model: Model, encode=text.characters) -> Transform:
    """Prompt to tokens and masks as the family wants them; the prompt is required and goes."""

    def run(df: DataFrame) -> DataFrame:
        if "prompt" not in df.columns:
            raise ValueError("Prompt is required")
        if model.family is Family.FAST:
            actions = None
            if "actions" in df.columns:
                actions = F.transform(F.flatten(F.transform("actions", lambda a: vector.discretize(a))), lambda t: text.remap(t, VOCABULARY))
            packed = text.pack_fast(text.fast_prefix(F.col("prompt"), vector.discretize(F.col("state"))), actions, model.tokens, encode)
            new = {"tokenized_prompt": packed["tokens"], "tokenized_prompt_mask": packed["mask"], "token_ar_mask": packed["ar_mask"], "token_loss_mask": packed["loss_mask"]}
        else:
            bins = vector.discretize(F.col("state")) if model.family is Family.FLOW_DISCRETE and model.discrete_state else None
            tokens, mask = text.encode_flow(F.col("prompt"), model.tokens, bins, encode)
            new = {"tokenized_prompt": tokens, "tokenized_prompt_mask": mask}
        return df.withColumns(new).drop("prompt")

    return run


SLOTS = tuple(ROBOTS["aloha"].cameras)


def resized(slots: Sequence[str] = SLOTS, height: int = 224, width: int = 224) -> Transform:
    """The images of the slots scaled without distortion and padded; a slot without an image stays absent."""

    def run(df: DataFrame) -> DataFrame:
        if "image" not in df.columns:
            return df
        new = F.create_map(*(x for s in slots for x in (F.lit(s), resize_with_pad(F.try_element_at("image", F.lit(s)), height, width))))
        return df.withColumn("image", F.map_filter(new, lambda _, v: v["data"].isNotNull()))

    return run


def observed(slots: Sequence[str] = SLOTS) -> Transform:
    """What a model wants of a record: an image for each slot (without one the record is an error), and a mask for each, true where none is given. Other slots go."""

    def run(df: DataFrame) -> DataFrame:
        missing = F.filter(F.array(*map(F.lit, slots)), lambda s: ~F.coalesce(F.map_contains_key("image", s), F.lit(False)))
        error = F.raise_error(F.concat(F.lit("images are missing: "), F.array_join(missing, ", ")))
        given = F.col("image_mask") if "image_mask" in df.columns else F.lit(None).cast("map<string,boolean>")
        mask = F.create_map(*(x for s in slots for x in (F.lit(s), F.coalesce(F.try_element_at(given, F.lit(s)), F.lit(True)))))
        images = F.when(F.size(missing) == 0, F.map_filter("image", lambda k, _: k.isin(*slots))).otherwise(error.cast(df.schema["image"].dataType))
        return df.withColumns({"image": images, "image_mask": mask})

    return run


def decoded(model: Model, encode=text.characters) -> Transform:
    """Tokens that a FAST model gave as actions to [horizon][dim] values; zeros where they are not whole. Other tables are unchanged.

    Like the way in, by bins: the trained action tokenisers are not built."""

    def run(df: DataFrame) -> DataFrame:
        if model.family is not Family.FAST or "actions" not in df.columns or structure.depth(df.schema, "actions") != 1:
            return df
        return df.withColumn("actions", text.decode_bins(text.action_tokens(F.col("actions"), VOCABULARY, encode), model.horizon, model.dim))

    return run


def padded(dim: int) -> Transform:
    """State and actions filled up to the model's dimension."""

    def run(df: DataFrame) -> DataFrame:
        new = {"state": vector.pad_to(F.col("state"), dim)}
        if "actions" in df.columns:
            new["actions"] = F.transform("actions", lambda a: vector.pad_to(a, dim))
        return df.withColumns(new)

    return run


@dataclass(frozen=True)
class Config:
    """A named pipeline."""

    name: str
    robot: str | None
    model: Model
    delta: tuple[int, ...] | None = None
    default_prompt: str | None = None
    repack: dict | None = field(default=None, hash=False)
    quantile: bool | None = None
    stored: dict | None = field(default=None, hash=False)
    sources: tuple[Source, ...] = ()
    delta_outputs_only: bool = False

    @property
    def scales_by_quantile(self) -> bool:
        """Quantiles but for the plain flow family."""
        return self.model.family is not Family.FLOW if self.quantile is None else self.quantile

    def data_group(self) -> Group:
        group = Group()
        if self.robot:
            group = group.push([robot_inputs(ROBOTS[self.robot], self.model)], [robot_outputs(ROBOTS[self.robot])])
        if self.delta:
            mask = vector.bool_mask(*self.delta)
            group = group.push([] if self.delta_outputs_only else [deltas(mask)], [deltas(mask, absolute=True)])
        return group

    @property
    def slots(self) -> tuple[str, ...]:
        robot = ROBOTS[self.robot] if self.robot else None
        return tuple((robot.fast_cameras if self.model.family is Family.FAST and robot.fast_cameras else robot.cameras) if robot else SLOTS)

    def training(self, stats: dict[str, NormStats]) -> Transform:
        """repack, robot, delta, scale, default prompt, resize, tokens, pad: the order matters, as statistics are of unpadded deltas."""
        steps: list[Transform] = [lambda df: structure.repack(df, self.repack)] if self.repack else []
        steps += [*self.data_group().inputs, scaled(stats, self.scales_by_quantile), lambda df: structure.default_column(df, "prompt", self.default_prompt), resized(self.slots), tokenized(self.model)]
        if self.model.family is not Family.FAST:
            steps.append(padded(self.model.dim))
        return structure.compose(*steps)

    def training_from_dataset(self, stats: dict[str, NormStats]) -> Transform:
        """training() of records as the robot's dataset stores them; `stored` says where their fields are, and others go."""
        if self.stored is None:
            return self.training(stats)
        return structure.compose(lambda df: structure.repack(df, self.stored), self.training(stats))

    def read_ranges(self, spark: SparkSession, folder: str) -> dict[str, DataFrame]:
        """episode, start and end of each filtered dataset of the mix, from its file below the folder."""
        return {s.name: datasets.read_ranges(spark, s.ranges_file(folder)) for s in self.sources if s.filtered}

    def mixed(self, frames: dict[str, DataFrame], ranges: dict[str, DataFrame] | str, key: str, episode: str = "episode", t: str = "t", seed: int = 0) -> DataFrame:
        """The datasets' frames within their own ranges (tables by name, or the folder of their files), in proportion to the weights."""
        if missing := [s.name for s in self.sources if s.name not in frames or s.filtered and not isinstance(ranges, str) and s.name not in ranges]:
            raise ValueError(f"no frames or ranges of {missing}")
        if isinstance(ranges, str):
            ranges = self.read_ranges(next(iter(frames.values())).sparkSession, ranges)
        return sampling.mixed({s.name: (lookup.frame_filter(frames[s.name], ranges[s.name] if s.filtered else None, episode, t), s.weight) for s in self.sources}, key, seed)

    def inference_outputs(self, stats: dict[str, NormStats]) -> Transform:
        """FAST decode, unscale, absolute, robot slice: deltas are undone at padded width."""
        return structure.compose(decoded(self.model), scaled(stats, self.scales_by_quantile, inverse=True), *self.data_group().outputs)


def _models() -> dict[str, Config]:
    flow = lambda h=50, d=32, n=48: Model(Family.FLOW, h, d, n)
    discrete = lambda h=50, d=32, n=200: Model(Family.FLOW_DISCRETE, h, d, n)
    fast = lambda h=32, d=32, n=250: Model(Family.FAST, h, d, n)
    arms, one_arm, seven = (6, -1, 6, -1), (6, -1), (7, -1)
    # The named configurations.
    rows = [
        *((n, "aloha", flow(), arms) for n in ("flow_aloha", "flow_aloha_towel", "flow_aloha_tupperware", "flow_aloha_pen_uncap")),
        *((n, "aloha", discrete(), arms) for n in ("discrete_aloha", "discrete_aloha_pen_uncap")),
        *((n, "yam", fast(50, 14, 300), arms) for n in ("fast_yam", "fast_yam_low_mem_finetune")),
        ("flow_droid", "droid", flow(10), None),
        ("fast_droid", "droid", fast(10, 8, 250), None),
        ("discrete_droid", "droid", discrete(15), None),
        *((n, "libero", flow(), one_arm) for n in ("flow_libero", "flow_libero_low_mem_finetune")),
        *((n, "libero", fast(10, 7, 180), one_arm) for n in ("fast_libero", "fast_libero_low_mem_finetune")),
        ("discrete_libero", "libero", replace(discrete(10), discrete_state=False), None),
        ("fast_full_droid_finetune", "droid", fast(16, 8, 180), seven),
        ("discrete_full_droid_finetune", "droid", discrete(16), seven),
        ("discrete_droid_finetune", "droid", discrete(16), None),
        ("flow_aloha_sim", "aloha", flow(), None),
        ("debug", None, flow(), None),
        ("debug_restore", None, flow(), None),
        ("debug_discrete", None, discrete(), None),
        ("fast_binning_droid_jointpos", "droid", replace(fast(15, 8, 600), tokenizer="binning"), seven),
        ("discrete_droid_jointpos_polaris", "droid", discrete(15), seven),
        ("fast_droid_jointpos_polaris", "droid", fast(10, 8, 180), seven),
        *((n, "droid", flow(10, 32, 100), seven) for n in ("flow_droid_jointpos_polaris", "flow_droid_jointpos_100k_polaris")),
        ("fast_binning_droid", "droid", replace(fast(15, 8, 400), tokenizer="binning"), None),
        ("fast_universal_droid", "droid", fast(15, 8), None),
        ("fast_specialist_droid", "droid", replace(fast(15, 8), tokenizer="fast_droid_specialist"), None),
        ("fast_vq_droid", "droid", replace(fast(15, 8), tokenizer="fsq"), None),
        ("flow_diffusion_droid", "droid", flow(10, 8), None),
    ]
    prompts = {
        "flow_aloha_towel": "fold the towel",
        "flow_aloha_tupperware": "open the tupperware and put the food on the plate",
        "flow_aloha_pen_uncap": "uncap the pen",
        "discrete_aloha_pen_uncap": "uncap the pen",
        "flow_aloha_sim": "Transfer cube",
    }
    droid_set = Source("droid", "1.0.1", 1.0)
    mix = (replace(droid_set, weight=0.9), Source("polaris_droid_cotrain_dataset", "1.0.0", 0.1))

    def stored(name: str, robot: str | None) -> dict | None:
        """Where a dataset's records have the fields; the configurations for inference alone have none, but for the two-arm robot's."""
        if robot == "aloha":
            cameras = ("cam_high", "cam_left_wrist", "cam_right_wrist") if name.endswith("pen_uncap") else ()
            images = {c: f"observation.images.{c}" for c in cameras} or {"cam_high": "observation.images.top"}
            return {**images, "state": "observation.state", "actions": "action"}
        if robot == "yam":
            return {**{f"{c}_image": f"observation.images.{c}" for c in ("top", "left_wrist", "right_wrist")}, "state": "observation.state", "actions": "action", "prompt": "prompt"}
        if robot == "libero":
            return {c: c for c in ("image", "wrist_image", "state", "actions", "prompt")}
        if name == "discrete_droid_finetune":
            return {c: c for c in ("exterior_image_1_left", "exterior_image_2_left", "wrist_image_left", "joint_position", "gripper_position", "actions", "prompt")}
        if sources(name):
            return {"exterior_image_1_left": "observation/image", "wrist_image_left": "observation/wrist_image", **{c: f"observation/{c}" for c in ("joint_position", "gripper_position")}, "actions": "actions", "prompt": "prompt"}
        return None

    def sources(name: str) -> tuple[Source, ...]:
        return mix if name.endswith("_polaris") else (droid_set,) if "full_droid" in name else ()

    configs = [Config(name, robot, model, delta, prompts.get(name), stored=stored(name, robot), sources=sources(name), delta_outputs_only=name == "fast_binning_droid_jointpos") for name, robot, model, delta in rows]
    if len({c.name for c in configs}) != len(configs):
        raise ValueError("config names must be unique")
    return {c.name: c for c in configs}


CONFIGS = _models()


def config(name: str) -> Config:
    """A configuration by name; the error of a miss names the closest."""
    if name in CONFIGS:
        return CONFIGS[name]
    near = max(CONFIGS, key=lambda k: SequenceMatcher(None, name, k).ratio())
    raise ValueError(f"no config {name}; did you mean {near}?")


def with_prompt(c: Config, prompt: str) -> Config:
    return replace(c, default_prompt=prompt)
