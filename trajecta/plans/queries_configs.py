"""Queries of recorded steps, two-arm vectors, whole configurations and result files; embeddings stand in for recorded vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import vector
from trajecta.operators import lookup
from trajecta.operators.stats import NormStats
from trajecta.plans import pipeline
from trajecta.plans.catalog import query, table
from trajecta.sources import datasets


def part(start, n):
    """n elements from the first, as doubles."""
    return F.slice("embedding", start, n).cast("array<double>")


def recorded(spark, sf_dir):
    """Steps with their actions, ids and whether a keep range holds them."""
    rows = table(spark, sf_dir, "embeddings")
    camera = F.lit(None).cast("binary")
    steps = rows.select(
        F.concat(F.lit("rec"), F.col("label").cast("string")).alias("recording_folderpath"),
        F.col("vec_id").cast("string").alias("file_path"),
        (F.col("vec_id") % 4).cast("int").alias("t"),
        F.struct(part(1, 7).alias("joint_position"), part(1, 7).alias("joint_velocity"), part(8, 1).alias("gripper_position")).alias("action_dict"),
        F.struct(camera.alias("exterior_image_1_left"), camera.alias("exterior_image_2_left"), camera.alias("wrist_image_left"), part(1, 7).alias("joint_position"), part(8, 1).alias("gripper_position")).alias("observation"),
        *(F.lit("go").alias(f"language_instruction{s}") for s in ("", "_2", "_3")),
    )
    ranges = rows.select(F.concat(F.lit("rec"), F.col("label").cast("string"), F.lit("--"), F.col("vec_id").cast("string")).alias("episode"), F.lit(0).alias("start"), (F.col("label") % 3 + 1).alias("end"))
    return lookup.restructured(steps, ranges)


@query(
    "restructured_steps",
    """SELECT 'rec' || label || '--' || vec_id AS episode, CAST(vec_id % 4 AS INT) AS t, 'rec' || label || '--' || vec_id || '--' || vec_id % 4 AS step_id, vec_id % 4 < 1 + label % 3 AS passes_filter,
 CAST(d AS INT) AS dim, round(CAST(embedding[d + 1] AS DOUBLE), 6) AS v FROM embeddings, (SELECT unnest(range(8)) AS d)""",
)
def restructured_steps(spark, sf_dir):
    """Recorded steps as actions with the gripper last, ids of episode and step, and whether a keep range holds the step."""
    made = recorded(spark, sf_dir)
    return made.select("episode", "t", "step_id", "passes_filter", F.posexplode("actions").alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("passing_steps", "SELECT 'rec' || label || '--' || vec_id || '--' || vec_id % 4 AS step_id, 8 AS width FROM embeddings WHERE vec_id % 4 < 1 + label % 3")
def passing_steps(spark, sf_dir):
    """The recorded steps that pass, without the flag."""
    return lookup.passing(recorded(spark, sf_dir)).select("step_id", F.size("actions").alias("width"))


PLACE = "vec_id // 64 AS y, vec_id % 64 AS x"
WAVE = "CASE WHEN i % 8 < 4 THEN sin(p * pow(1e4, -(i % 4) / 3e0)) ELSE cos(p * pow(1e4, -(i % 4) / 3e0)) END"


@query("sincos_grid", f"SELECT vec_id, CAST(i AS INT) AS dim, round({WAVE}, 5) AS v FROM (SELECT vec_id, i, CASE WHEN i < 8 THEN x ELSE y END AS p FROM (SELECT vec_id, {PLACE} FROM embeddings), (SELECT unnest(range(16)) AS i))")
def sincos_grid(spark, sf_dir):
    """Places on a grid 64 wide as waves of 16 dimensions."""
    made = vector.sincos_embedding_2d(F.floor(F.col("vec_id") / 64), F.col("vec_id") % 64, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(made).alias("dim", "v")).withColumn("v", F.round("v", 5))


@query("observation_masks", "SELECT conv_id, turn, slot, CASE WHEN slot = 'base_0_rgb' AND turn % 2 = 0 THEN role = 'user' ELSE true END AS mask FROM conversations, (SELECT unnest(['base_0_rgb', 'left_wrist_0_rgb', 'right_wrist_0_rgb']) AS slot)")
def observation_masks(spark, sf_dir):
    """Masks that a record gives, and true for the others."""
    image = F.struct(F.lit(b"\0").alias("data"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.create_map(*(x for s in (*pipeline.SLOTS, "other") for x in (F.lit(s), image))).alias("image"),
        F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("base_0_rgb"), F.col("role") == "user")).alias("image_mask"),
    )
    made = pipeline.observed()(rows).where(F.size("image") == 3)
    return made.select("conv_id", "turn", F.explode("image_mask").alias("slot", "mask"))


@query(
    "two_arm_vectors",
    """WITH e AS (SELECT vec_id, a, d, CAST(embedding[a * 8 + d + 1] AS DOUBLE) AS j, CAST(embedding[a * 8 + 7] AS DOUBLE) AS g6, CAST(embedding[a * 8 + 8] AS DOUBLE) AS g7 FROM embeddings, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(7)) AS d))
 SELECT vec_id, CAST(a * 7 + d AS INT) AS dim, round(CASE WHEN d < 6 THEN j ELSE (g7 - 0.01844e0) / (0.058e0 - 0.01844e0) END, 5) AS position, round(CASE WHEN d < 6 THEN j ELSE g7 / (0.058e0 - 0.01844e0) END, 5) AS velocity,
 round(j, 5) AS effort, round(CASE WHEN d < 6 THEN j ELSE (g6 + 0.6842e0) / (0.3083e0 + 0.6842e0) END, 5) AS action FROM e""",
)
def two_arm_vectors(spark, sf_dir):
    left, right = part(1, 8), part(9, 8)
    kinds = {"position": vector.two_arm_position, "velocity": vector.two_arm_velocity, "effort": vector.two_arm_effort, "action": vector.two_arm_action}
    made = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(*(f(left, right).alias(k) for k, f in kinds.items()))).alias("dim", "_x"))
    return made.select("vec_id", "dim", *(F.round(F.col(f"_x.{k}"), 5).alias(k) for k in kinds))


# Of each configuration: how many action dimensions are relative, whether quantiles scale, and the model's width (0: not padded).
TRAINED = {"flow_libero": (6, False, 32), "fast_libero": (6, True, 0), "discrete_libero": (0, True, 32)}


def _scaled(v: str, quantile: bool) -> str:
    if quantile:
        return f"(({v}) - (-1e0 - d / 10e0)) / ((1e0 + d / 5e0) - (-1e0 - d / 10e0) + 1e-6) * 2e0 - 1e0"
    return f"(({v}) - d / 100e0) / ((0.5e0 + d / 10e0) + 1e-6)"


def _trained(name: str, deltas: int, quantile: bool, width: int) -> str:
    state, action = "CAST(embedding[d + 1] AS DOUBLE)", f"CAST(embedding[9 + s * 7 + d] AS DOUBLE) - CASE WHEN d < {deltas} THEN CAST(embedding[d + 1] AS DOUBLE) ELSE 0e0 END"
    return f"""SELECT '{name}' AS config, vec_id, 'state' AS field, 0 AS step, {width or 8} AS width, sum((d + 1) * ({_scaled(state, quantile)})) AS total FROM embeddings, (SELECT unnest(range(8)) AS d) GROUP BY vec_id
 UNION ALL SELECT '{name}', vec_id, 'actions', s, {width or 7}, sum((d + 1) * ({_scaled(action, quantile)})) FROM embeddings, (SELECT unnest(range(7)) AS d), (SELECT unnest(range(2)) AS s) GROUP BY vec_id, s"""


@query("training_records", f"SELECT config, vec_id, field, CAST(step AS INT) AS step, CAST(width AS INT) AS width, round(total, 4) AS total FROM ({' UNION ALL '.join(_trained(n, *c) for n, c in TRAINED.items())})")
def training_records(spark, sf_dir):
    """A dataset's records through one configuration of each family: repacked, relative, scaled, padded. Of each vector its width and the sum of its elements
    times their places; images are null and, as nothing asks for them, never made."""
    numbers = lambda n, f: [f(d) for d in range(n)]
    stats = {k: NormStats(numbers(n, lambda d: d / 100), numbers(n, lambda d: 0.5 + d / 10), numbers(n, lambda d: -1 - d / 10), numbers(n, lambda d: 1 + d / 5)) for k, n in (("state", 8), ("actions", 7))}
    camera = F.lit(None).cast("struct<data:binary,h:int,w:int,c:int>")
    records = table(spark, sf_dir, "embeddings").select("vec_id", camera.alias("image"), camera.alias("wrist_image"), part(1, 8).alias("state"), F.array(part(9, 7), part(16, 7)).alias("actions"), F.lit("go").alias("prompt"))
    out = None
    for name in TRAINED:
        config = pipeline.config(name)
        stored = pipeline.replace(config, stored={**config.stored, "vec_id": "vec_id"})
        ready = stored.training_from_dataset(stats)(records)
        vectors = F.explode(F.concat(F.array(F.struct(F.lit("state").alias("field"), F.lit(0).alias("step"), F.col("state").alias("v"))), F.transform("actions", lambda a, i: F.struct(F.lit("actions").alias("field"), i.alias("step"), a.alias("v")))))
        found = ready.select(F.lit(name).alias("config"), "vec_id", vectors.alias("_x")).select("config", "vec_id", "_x.field", "_x.step", F.size("_x.v").alias("width"), F.col("_x.v").alias("_v"))
        total = F.aggregate(F.transform("_v", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        found = found.select("config", "vec_id", "field", "step", "width", F.round(total, 4).alias("total"))
        out = found if out is None else out.unionByName(found)
    return out


@query("result_files", "SELECT kind, conv_id, turn, length(text) AS n, CASE WHEN turn % 2 = 0 THEN role END AS role FROM conversations, (SELECT unnest(['csv', 'jsonl', 'timings']) AS kind)")
def result_files(spark, sf_dir):
    """Results, records and timings written as files over what an earlier run left there, and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("role"))
    base, out = datasets.scratch(spark, "results"), None
    for kind, write, read in (
        ("csv", datasets.write_results, lambda p: spark.read.schema(rows.schema).option("header", "true").csv(p)),
        ("jsonl", datasets.write_jsonl, lambda p: spark.read.schema(rows.schema).json(p)),
        ("timings", datasets.write_timings, spark.read.parquet),
    ):
        write(rows.limit(1), f"{base}/{kind}")
        write(rows, f"{base}/{kind}")
        found = read(f"{base}/{kind}").select(F.lit(kind).alias("kind"), "*")
        out = found if out is None else out.unionByName(found)
    return out
