"""Lookups as joins. Nothing is broadcast by hint: sides whose size is not fixed are left to the planner and to adaptive execution, which see their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajecta.operators import sampling


def required(df: DataFrame, table: DataFrame, key: str, value: str, out: str, error: str = "not found") -> DataFrame:
    """df with table[key]; a key without a row is an error."""
    found = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_hit"))
    joined = df.join(found, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(out, F.when(F.col("_hit"), F.col("_value")).otherwise(F.raise_error(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f" {error}"))))).drop("_key", "_value", "_hit")


def optional(df: DataFrame, table: DataFrame, key: str, value: str, out: str, default: object) -> DataFrame:
    """df with table[key], or the default."""
    found = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return df.join(found, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def frame_filter(frames: DataFrame, ranges: DataFrame | None, episode: str, t: str) -> DataFrame:
    """Frames in one of their episode's half-open ranges; without ranges all. No range is expanded into frames."""
    if ranges is None:
        return frames
    r = ranges.select(F.col(episode).alias("_episode"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return frames.join(r, (F.col(episode) == F.col("_episode")) & (F.col(t) >= F.col("_start")) & (F.col(t) < F.col("_end")), "left_semi")


def frame_flags(frames: DataFrame, ranges: DataFrame, episode: str, t: str, out: str = "passes_filter") -> DataFrame:
    """The same as a flag; false for an unknown episode. An episode's ranges are one array, so that frames are not multiplied."""
    r = ranges.groupBy(F.col(episode).alias("_episode")).agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
    inside = F.exists("_ranges", lambda x: (F.col(t) >= x["start"]) & (F.col(t) < x["end"]))
    return frames.join(r, F.col(episode) == F.col("_episode"), "left").withColumn(out, F.coalesce(inside, F.lit(False))).drop("_episode", "_ranges")


def restructured(steps: DataFrame, ranges: DataFrame | None = None, joint_position: bool = True, seed: int = 0) -> DataFrame:
    """Recorded steps (recording_folderpath, file_path, t, action_dict, observation, language_instruction, _2, _3) as actions, observation, prompt,
    step_id and passes_filter; the outer camera and the instruction are chosen by trajectory. ranges are by episode `folder--file`; without them all pass."""
    episode = F.concat_ws("--", "recording_folderpath", "file_path")
    key, action = F.xxhash64("recording_folderpath", "file_path"), "joint_position" if joint_position else "joint_velocity"
    outer = F.when(sampling.unit(key, seed) > 0.5, F.col("observation.exterior_image_1_left")).otherwise(F.col("observation.exterior_image_2_left"))
    names = F.array("language_instruction", "language_instruction_2", "language_instruction_3")
    made = steps.select(
        episode.alias("episode"),
        "t",
        F.concat(F.col(f"action_dict.{action}"), F.col("action_dict.gripper_position")).alias("actions"),
        F.struct(outer.alias("image"), F.col("observation.wrist_image_left").alias("wrist_image"), F.col("observation.joint_position").alias("joint_position"), F.col("observation.gripper_position").alias("gripper_position")).alias("observation"),
        sampling.chosen(key, names, seed + 1).alias("prompt"),
        F.concat_ws("--", episode, F.col("t").cast("string")).alias("step_id"),
    )
    return made.withColumn("passes_filter", F.lit(True)) if ranges is None else frame_flags(made, ranges, "episode", "t")


def passing(frames: DataFrame, flag: str = "passes_filter") -> DataFrame:
    """The frames whose flag is true, without the flag; a null flag does not pass."""
    return frames.where(F.col(flag)).drop(flag)


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def parameter_merge(loaded: DataFrame, reference: DataFrame, missing: str) -> DataFrame:
    """Loaded parameters that the reference has, with its type, and those only it has whose path matches the pattern in full."""
    both = loaded.join(reference.select("path", F.col("dtype").alias("_dtype")), "path").select("path", F.col("_dtype").alias("dtype"), "value")
    rest = reference.join(loaded.select("path"), "path", "left_anti").where(F.col("path").rlike(f"^(?:{missing})$")).select("path", "dtype", "value")
    return both.unionByName(rest)


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def latest(events: DataFrame, readings: DataFrame, key: str, ts: str, value: str, out: str) -> DataFrame:
    """Events with the last reading of their key at or before their time: a union and one window, no range join."""
    e = events.withColumns({"_reading": F.lit(None).cast(readings.schema[value].dataType), "_kind": F.lit(1)})
    r = readings.select(F.col(key), F.col(ts), F.col(value).alias("_reading"), F.lit(0).alias("_kind"))
    window = Window.partitionBy(key).orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(r, allowMissingColumns=True).withColumn(out, F.last("_reading", ignorenulls=True).over(window))
    return both.where("_kind = 1").drop("_reading", "_kind")


def nearest_name(df: DataFrame, name: str, known: list[str], out: str) -> DataFrame:
    """The known name with the least edit distance, the first of equals in order."""
    options = F.array(*(F.struct(F.levenshtein(F.col(name), F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in sorted(known)))
    return df.withColumn(out, F.array_min(options)["k"])


def named(key: Column, table: dict[str, str], error: str | None = None) -> Column:
    """A constant map; a missing key is null, or an error."""
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]
    return found if error is None else F.coalesce(found, F.raise_error(F.concat(key, F.lit(f" {error}"))))


def first_match(path: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the first pattern that the path starts with, as an ordered rule list."""
    out = None
    for pattern, value in rules:
        out = (F if out is None else out).when(path.rlike(f"^(?:{pattern})"), F.lit(value))
    return out.otherwise(F.lit(default))


def stale(path: Column, modified: Column, rules: list[tuple[str, int]]) -> Column:
    """Whether a cached file is not newer than the expiry of the first rule that its path starts with; without one, fresh."""
    return modified <= first_match(path, [(p, int(t)) for p, t in rules], -(1 << 62))
