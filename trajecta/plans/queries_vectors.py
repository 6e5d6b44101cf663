"""Queries of vector algebra, statistics and tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions import images, metrics, text, vector, wire
from trajecta.operators import sequence, stats
from trajecta.plans.catalog import EV, LI, LONG, ev_frames, exploded, li_frames, query, table

HORIZON = 4
MEAN, STD, LOW, HIGH = [25.0, 30000.0, 0.05, 0.04], [14.0, 20000.0, 0.03, 0.02], [1.0, 900.0, 0.0, 0.0], [50.0, 95000.0, 0.1, 0.08]
# Steps ahead by windows over whole rows, beyond the end the last one; dimensions are unpivoted last.
_AHEAD = ", ".join(f"coalesce(lead({c}, {k}) OVER w, last_value({c}) OVER w) AS {c}{k}" for k in range(HORIZON) for c in "qpdx")
_STEPS = " UNION ALL ".join(f"SELECT episode, t, {k} AS k, {i} AS dim, {c}{k} - {c if i < 2 else 0} AS v, {c}{k} AS raw, {c} AS own FROM ah" for k in range(HORIZON) for i, c in enumerate("qpdx"))
CHUNKS = f"""{LI}, ah AS (SELECT *, {_AHEAD} FROM li WINDOW w AS (PARTITION BY episode ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 ch AS ({_STEPS})"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = li_frames(spark, sf_dir)
    return frames.withColumn("actions", sequence.chunk(F.col("state"), "episode", "t", HORIZON))


def stat_sql(name: str, dims: int = 4) -> str:
    return "CASE dim " + " ".join(f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate({"MEAN": MEAN, "STD": STD, "LOW": LOW, "HIGH": HIGH}[name][:dims])) + " END"


@query("chunk_delta_stats", f"WITH {CHUNKS} SELECT 'actions' AS field, dim, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max FROM ch GROUP BY dim")
def chunk_delta_stats(spark, sf_dir):
    moved = chunks(spark, sf_dir).withColumn("actions", vector.delta_actions(F.col("actions"), F.col("state"), vector.bool_mask(2, -2)))
    out = stats.moments(stats.chunk_elements(moved, F.col("actions"), "actions"))
    return out.select("field", "dim", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")))


def steps(df: DataFrame, column: str) -> DataFrame:
    out = df.select("episode", "t", F.posexplode(column).alias("k", "_step"))
    return exploded(out, "_step", "episode", "t", "k", digits=4)


@query("chunk_clamp", f"WITH {CHUNKS} SELECT episode, t, CAST(k AS INT) AS k, CAST(dim AS INT) AS dim, round(raw, 4) AS v FROM ch")
def chunk_clamp(spark, sf_dir):
    return steps(chunks(spark, sf_dir), "actions")


@query("delta_actions", f"WITH {CHUNKS} SELECT episode, t, CAST(k AS INT) AS k, CAST(dim AS INT) AS dim, round(v, 4) AS v FROM ch")
def delta_actions(spark, sf_dir):
    return steps(chunks(spark, sf_dir).withColumn("actions", vector.delta_actions(F.col("actions"), F.col("state"), vector.bool_mask(2, -2))), "actions")


@query("absolute_actions", f"WITH {CHUNKS} SELECT episode, t, CAST(k AS INT) AS k, CAST(dim AS INT) AS dim, round(raw + CASE WHEN dim < 2 THEN own ELSE 0 END, 4) AS v FROM ch")
def absolute_actions(spark, sf_dir):
    return steps(chunks(spark, sf_dir).withColumn("actions", vector.absolute_actions(F.col("actions"), F.col("state"), vector.bool_mask(2, -2))), "actions")


@query("norm_stats_moments", f"WITH {LONG} SELECT 'state' AS field, CAST(dim AS INT) AS dim, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max FROM lo GROUP BY dim")
def norm_stats_moments(spark, sf_dir):
    out = stats.moments(stats.elements(li_frames(spark, sf_dir), F.col("state"), "state"))
    return out.select("field", "dim", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")))


@query(
    "norm_stats_hist_quantiles",
    f"""WITH {LONG}, e AS (SELECT dim, min(v) AS low, (max(v) - min(v)) / 5000 AS width, count(*) AS n FROM lo GROUP BY dim),
 b AS (SELECT lo.dim, least(4999, floor((v - low) / width)) AS bin, any_value(low) AS low, any_value(width) AS width, any_value(n) AS total, count(*) AS c FROM lo JOIN e ON e.dim = lo.dim GROUP BY 1, 2),
 r AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin) AS run FROM b)
 SELECT 'state' AS field, CAST(dim AS INT) AS dim, round(min(CASE WHEN run >= 0.01 * total THEN low + bin * width END), 5) AS q01, round(min(CASE WHEN run >= 0.99 * total THEN low + bin * width END), 5) AS q99 FROM r GROUP BY dim""",
)
def norm_stats_hist_quantiles(spark, sf_dir):
    out = stats.histogram_quantiles(stats.elements(li_frames(spark, sf_dir), F.col("state"), "state"), {"q01": 0.01, "q99": 0.99})
    return out.select("field", "dim", F.round("q01", 5).alias("q01"), F.round("q99", 5).alias("q99"))


def element_query(name: str, body, sql: str, digits: int = 6) -> None:
    @query(name, f"WITH {LONG} SELECT episode, t, CAST(dim AS INT) AS dim, round({sql}, {digits}) AS v FROM lo")
    def run(spark, sf_dir):
        return exploded(li_frames(spark, sf_dir).withColumn("y", body(F.col("state"))), "y", "episode", "t", digits=digits)


two = lambda v: vector.literal(v[:2])
element_query("normalize_z", lambda x: vector.normalize_z(x, vector.literal(MEAN), vector.literal(STD)), f"(v - {stat_sql('MEAN')}) / ({stat_sql('STD')} + 1e-6)")
element_query("normalize_quantile", lambda x: vector.normalize_quantile(x, vector.literal(LOW), vector.literal(HIGH)), f"(v - {stat_sql('LOW')}) / ({stat_sql('HIGH')} - {stat_sql('LOW')} + 1e-6) * 2.0 - 1.0")
element_query("unnormalize_z", lambda x: vector.unnormalize_z(x, two(MEAN), two(STD)), f"v * (coalesce({stat_sql('STD', 2)}, 1.0) + 1e-6) + coalesce({stat_sql('MEAN', 2)}, 0.0)", 1)
element_query("unnormalize_quantile", lambda x: vector.unnormalize_quantile(x, two(LOW), two(HIGH)), f"CASE WHEN dim < 2 THEN (v + 1.0) / 2.0 * ({stat_sql('HIGH', 2)} - {stat_sql('LOW', 2)} + 1e-6) + {stat_sql('LOW', 2)} ELSE v END", 2)
element_query("discretize_state", lambda x: vector.discretize(F.transform(x, lambda v: v * 20.0 - 1.5)).cast("array<double>"), "CAST(greatest(-1, least(255, floor(greatest(-2.0, least(2.0, v * 20.0 - 1.5)) * 128) + 128)) AS DOUBLE)")


@query("pad_to_dim", f"WITH {LONG} SELECT episode, t, CAST(dim AS INT) AS dim, round(v, 6) AS v FROM lo UNION ALL SELECT episode, t, 4, 0.0 FROM li UNION ALL SELECT episode, t, 5, 0.0 FROM li")
def pad_to_dim(spark, sf_dir):
    return exploded(li_frames(spark, sf_dir).withColumn("y", vector.pad_to(F.col("state"), 6)), "y", "episode", "t")


@query("stride_subsample", f"WITH {LONG} SELECT episode, t, CAST(dim // 2 AS INT) AS dim, round(v, 6) AS v FROM lo WHERE dim % 2 = 0")
def stride_subsample(spark, sf_dir):
    return exploded(li_frames(spark, sf_dir).withColumn("y", vector.stride(F.col("state"), 2)), "y", "episode", "t")


@query("slice_head", f"WITH {LONG} SELECT episode, t, CAST(dim AS INT) AS dim, round(v, 6) AS v FROM lo WHERE dim < 3")
def slice_head(spark, sf_dir):
    return exploded(li_frames(spark, sf_dir).withColumn("y", vector.head(F.col("state"), 3)), "y", "episode", "t")


@query("bool_mask", "SELECT CAST(i AS INT) AS i, i < 6 OR i BETWEEN 7 AND 12 AS flag FROM (SELECT unnest(range(14)) AS i)")
def bool_mask(spark, sf_dir):
    flags = vector.bool_mask(6, -1, 6, -1)
    return spark.range(len(flags)).select(F.col("id").cast("int").alias("i"), F.get(F.array(*map(F.lit, flags)), F.col("id").cast("int")).alias("flag"))


@query("gripper_angles", f"""WITH {LI}, g AS (SELECT episode, t, x * 12.5 AS u, (x * 12.5) * 0.03956 + 0.01844 AS m FROM li)
 SELECT episode, t, round((asin(greatest(-1.0, least(1.0, (m * m + 0.000484 - 0.001296) / (0.044 * m)))) - 0.5476) / 1.082, 6) AS angle,
 round((u + 0.5476 + 0.6213) / 2.1123, 6) AS joint, round((u * 2.1123 - 0.6213) - 0.5476, 3) AS back FROM g""")
def gripper_angles(spark, sf_dir):
    u = F.get("state", F.lit(3)) * 12.5
    return li_frames(spark, sf_dir).select("episode", "t", F.round(vector.gripper_to_angular(u), 6).alias("angle"), F.round(vector.gripper_from_angular(u), 6).alias("joint"), F.round(vector.gripper_from_angular_inverse(u), 3).alias("back"))


@query("gripper_scales", f"""WITH {LI} SELECT episode, t, round((d - 0.01244) / 0.01173, 6) AS unit, round((d - 0.01244) / 0.01173 * 0.03956 + 0.01844, 6) AS follower,
 round((d - 0.01844) / 0.03956 * 2.1123 - 0.6213, 6) AS joint, round(d / 0.03956, 6) AS velocity FROM li""")
def gripper_scales(spark, sf_dir):
    d = F.get("state", F.lit(2))
    return li_frames(spark, sf_dir).select("episode", "t", F.round(vector.gripper_convert(d, "leader", "unit"), 6).alias("unit"), F.round(vector.gripper_convert(d, "leader", "follower"), 6).alias("follower"), F.round(vector.gripper_convert(d, "follower", "follower_joint"), 6).alias("joint"), F.round(vector.gripper_velocity(d, "follower"), 6).alias("velocity"))


@query("joint_flip", "SELECT vec_id, CAST(i AS INT) AS dim, round(CAST(embedding[i + 1] AS DOUBLE) * CASE WHEN i IN (1, 2, 8, 9) THEN -1 ELSE 1 END, 6) AS v FROM embeddings, (SELECT unnest(range(14)) AS i)")
def joint_flip(spark, sf_dir):
    state = F.transform(F.slice("embedding", 1, 14), lambda v: v.cast("double"))
    return exploded(table(spark, sf_dir, "embeddings").withColumn("y", vector.flip_joints(state)), "y", "vec_id")


@query("quaternion_axis_angle", """WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, greatest(-1.0, least(1.0, CAST(embedding[4] AS DOUBLE) * 4)) AS w FROM embeddings),
 s AS (SELECT *, sqrt(1.0 - w * w) AS size FROM q) SELECT vec_id, CAST(i AS INT) AS dim, round(CASE WHEN size < 1e-8 THEN 0.0 ELSE (CASE i WHEN 0 THEN a WHEN 1 THEN b ELSE c END) * 2.0 * acos(w) / size END, 5) AS v FROM s, (SELECT unnest(range(3)) AS i)""")
def quaternion_axis_angle(spark, sf_dir):
    d = lambda i: F.get("embedding", F.lit(i)).cast("double")
    y = vector.quaternion_to_axis_angle(F.array(d(0), d(1), d(2), d(3) * 4))
    return exploded(table(spark, sf_dir, "embeddings").withColumn("y", y), "y", "vec_id", digits=5)


@query("binarize_gripper", f"WITH {LONG} SELECT episode, t, CAST(dim AS INT) AS dim, round(greatest(-1.0, least(1.0, CASE WHEN dim = 3 THEN CASE WHEN v * 10 > 0.5 THEN 1.0 ELSE 0.0 END ELSE v * 10 END)), 6) AS v FROM lo")
def binarize_gripper(spark, sf_dir):
    scaled = F.transform("state", lambda v: v * 10)
    return exploded(li_frames(spark, sf_dir).withColumn("y", vector.binarize_last(scaled)), "y", "episode", "t")


FSQ = (8, 5, 5, 5)


@query("fsq_codes", """SELECT p_partkey, CAST((p_partkey % 8) + (p_size % 5) * 8 + ((p_partkey // 7) % 5) * 40 + ((p_partkey // 11) % 5) * 200 AS BIGINT) AS code,
 CAST(p_partkey % 8 AS INT) AS d0, CAST(p_size % 5 AS INT) AS d1, CAST((p_partkey // 7) % 5 AS INT) AS d2, CAST((p_partkey // 11) % 5 AS INT) AS d3 FROM part""")
def fsq_codes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    digits = F.array(F.col("p_partkey") % 8, F.col("p_size") % 5, F.floor(F.col("p_partkey") / 7) % 5, F.floor(F.col("p_partkey") / 11) % 5)
    coded = part.select("p_partkey", vector.mixed_radix_encode(digits, FSQ).alias("code"))
    back = vector.mixed_radix_decode(F.col("code"), FSQ)
    return coded.select("p_partkey", "code", *(F.get(back, F.lit(i)).alias(f"d{i}") for i in range(4)))


@query("fsq_levels", "SELECT vec_id, CAST(round_even((tanh(CAST(embedding[1] AS DOUBLE) * 4) + 1.0) * 7 / 2.0, 0) AS INT) AS level, round(round_even((tanh(CAST(embedding[1] AS DOUBLE) * 4) + 1.0) * 7 / 2.0, 0) / 7 * 2.0 - 1.0, 6) AS value FROM embeddings")
def fsq_levels(spark, sf_dir):
    level = vector.fsq_quantize(F.get("embedding", F.lit(0)).cast("double") * 4, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", level.alias("level")).withColumn("value", F.round(vector.fsq_dequantize(F.col("level"), 8), 6))


@query("sign_bits", "SELECT vec_id, CAST(" + " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(10)) + " AS INT) AS code, CAST(CASE WHEN embedding[3] > 0 THEN 1.0 ELSE -1.0 END AS DOUBLE) AS third FROM embeddings")
def sign_bits(spark, sf_dir):
    coded = table(spark, sf_dir, "embeddings").select("vec_id", vector.sign_bits_encode(F.slice("embedding", 1, 10)).alias("code"))
    return coded.withColumn("third", F.get(vector.sign_bits_decode(F.col("code"), 10), F.lit(2)).cast("double"))


@query("pose_lerp", "SELECT p_partkey, CAST(k AS INT) AS k, round(CAST(p_size AS DOUBLE) + (p_retailprice - p_size) * k / 4.0, 4) AS v FROM part, (SELECT unnest(range(5)) AS k)")
def pose_lerp(spark, sf_dir):
    path = vector.lerp(F.array(F.col("p_size").cast("double")), F.array("p_retailprice"), 5)
    out = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(path).alias("k", "_v"))
    return out.select("p_partkey", "k", F.round(F.get("_v", F.lit(0)), 4).alias("v"))


PERIODS = [4e-3 * (4.0 / 4e-3) ** (k / 3) for k in range(4)]


@query("sincos_embedding", "SELECT p_partkey, CAST(i AS INT) AS dim, round(CASE WHEN i < 4 THEN sin(a) ELSE cos(a) END, 5) AS v FROM (SELECT p_partkey, i, (p_size / 50.0) * (CASE i % 4 " + " ".join(f"WHEN {k} THEN CAST({2 * math.pi / p!r} AS DOUBLE)" for k, p in enumerate(PERIODS)) + " END) AS a FROM part, (SELECT unnest(range(8)) AS i))")
def sincos_embedding(spark, sf_dir):
    y = vector.sincos_embedding(F.col("p_size") / 50.0, 8, 4e-3, 4.0)
    return exploded(table(spark, sf_dir, "part").withColumn("y", y), "y", "p_partkey", digits=5)


@query("flow_mix", """SELECT vec_id, CAST(i AS INT) AS dim, round(t * n + (1.0 - t) * a, 5) AS x, round(n - a, 5) AS u FROM (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS a, CAST(embedding[i + 5] AS DOUBLE) AS n, pow((vec_id % 97) / 97.0, 1 / 1.5) * 0.999 + 0.001 AS t FROM embeddings, (SELECT unnest(range(4)) AS i))""")
def flow_mix(spark, sf_dir):
    part = lambda k: F.transform(F.slice("embedding", k, 4), lambda v: v.cast("double"))
    x, u = vector.flow_mix(part(1), part(5), vector.flow_time((F.col("vec_id") % 97) / 97.0))
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(x.alias("x"), u.alias("u"))).alias("dim", "_z"))
    return out.select("vec_id", "dim", F.round("_z.x", 5).alias("x"), F.round("_z.u", 5).alias("u"))


@query("lr_schedules", """SELECT CAST(s AS BIGINT) AS step, round(1e6 * CASE WHEN s < 1000 THEN 2.5e-5 / 1001 + (2.5e-5 - 2.5e-5 / 1001) * s / 1000 ELSE 2.5e-6 + 2.25e-5 * 0.5 * (1 + cos(pi() * least(1.0, (s - 1000) / 29000.0))) END, 6) AS cosine,
 round(1e6 * CASE WHEN s < 1000 THEN 5e-5 / 1001 + (5e-5 - 5e-5 / 1001) * s / 1000 ELSE 5e-5 / sqrt((10000.0 + s - 1000) / 10000) END, 6) AS inverse_root FROM (SELECT DISTINCT event_id * 17 % 40000 AS s FROM events)""")
def lr_schedules(spark, sf_dir):
    s = table(spark, sf_dir, "events").select((F.col("event_id") * 17 % 40000).alias("step")).distinct()
    return s.select("step", F.round(metrics.cosine(F.col("step")) * 1e6, 6).alias("cosine"), F.round(metrics.inverse_root(F.col("step")) * 1e6, 6).alias("inverse_root"))



@query("prompt_clean_flow", "SELECT doc_id, replace(replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '_', ' '), chr(10), ' ') AS prompt FROM documents")
def prompt_clean_flow(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_flow(F.col("text")).alias("prompt"))


@query("prompt_clean_fast", "SELECT doc_id, replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '_', ' ') AS prompt FROM documents")
def prompt_clean_fast(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_fast(F.col("text")).alias("prompt"))


@query("prefix_templates", """SELECT p_partkey, 'Task: ' || trim(p_name) || ', State: ' || CAST(a AS VARCHAR) || ' ' || CAST(b AS VARCHAR) || ';' || chr(10) || 'Action: ' AS flow, 'Task: ' || trim(lower(p_name)) || ', State: ' || CAST(a AS VARCHAR) || ' ' || CAST(b AS VARCHAR) || ';' || chr(10) AS fast
 FROM (SELECT *, CAST(greatest(-1, least(255, floor((p_size / 25.0 - 1) * 128) + 128)) AS INT) AS a, CAST(greatest(-1, least(255, floor(greatest(-2.0, least(2.0, p_retailprice / 1000 - 1)) * 128) + 128)) AS INT) AS b FROM part)""")
def prefix_templates(spark, sf_dir):
    bins = vector.discretize(F.array(F.col("p_size") / 25.0 - 1, F.col("p_retailprice") / 1000 - 1))
    return table(spark, sf_dir, "part").select("p_partkey", text.flow_prefix(F.col("p_name"), bins).alias("flow"), text.fast_prefix(F.col("p_name"), bins).alias("fast"))


@query("token_pad_mask", "SELECT p_partkey, CAST(i AS INT) AS place, CAST(CASE WHEN i = 0 THEN 2 WHEN i <= length(n) THEN ascii(substr(n, CAST(i AS BIGINT), 1)) + 3 WHEN i = length(n) + 1 THEN 108 ELSE 0 END AS INT) AS token, i <= length(n) + 1 AS valid FROM (SELECT p_partkey, trim(p_name) AS n FROM part), (SELECT unnest(range(12)) AS i)")
def token_pad_mask(spark, sf_dir):
    tokens, mask = text.encode_flow(F.col("p_name"), 12)
    out = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.arrays_zip(tokens.alias("token"), mask.alias("valid"))).alias("place", "_z"))
    return out.select("p_partkey", "place", "_z.token", "_z.valid")


PACKED = """px AS (SELECT p_partkey, 'Task: ' || trim(lower(p_name)) || ', State: 7;' || chr(10) AS pre, 'Action: ' AS act FROM part),
 tk AS (SELECT p_partkey, i, length(pre) AS m, CASE WHEN i = 0 THEN 2 WHEN i <= length(pre) THEN ascii(substr(pre, CAST(i AS BIGINT), 1)) + 3 WHEN i <= length(pre) + 8 THEN ascii(substr(act, CAST(i - length(pre) AS BIGINT), 1)) + 3
 WHEN i = length(pre) + 9 THEN 500 WHEN i = length(pre) + 10 THEN 501 WHEN i = length(pre) + 11 THEN 127 WHEN i = length(pre) + 12 THEN 1 ELSE 0 END AS token FROM px, (SELECT unnest(range(48)) AS i))"""


@query("fast_packing", f"WITH {PACKED} SELECT p_partkey, CAST(i AS INT) AS place, CAST(token AS INT) AS token, i <= m + 12 AS valid, CAST(CASE WHEN i > m AND i <= m + 12 THEN 1 ELSE 0 END AS INT) AS ar, i > m AND i <= m + 12 AS scored FROM tk")
def fast_packing(spark, sf_dir):
    packed = text.pack_fast(text.fast_prefix(F.col("p_name"), F.array(F.lit(7))), F.array(F.lit(500), F.lit(501)), 48)
    zipped = F.arrays_zip(packed["tokens"].alias("token"), packed["mask"].alias("valid"), packed["ar_mask"].alias("ar"), packed["loss_mask"].alias("scored"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(zipped).alias("place", "_z")).select("p_partkey", "place", "_z.token", "_z.valid", "_z.ar", "_z.scored")


@query("token_remap", "SELECT p_partkey, CAST(257152 - 1 - 128 - p_size AS INT) AS mapped, CAST(p_size AS INT) AS back FROM part")
def token_remap(spark, sf_dir):
    mapped = text.remap(F.col("p_size"), 257_152)
    return table(spark, sf_dir, "part").select("p_partkey", mapped.cast("int").alias("mapped"), text.remap(mapped, 257_152).cast("int").alias("back"))


@query("action_marker", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS found FROM part")
def action_marker(spark, sf_dir):
    said = F.concat(F.lit("Task: x;"), F.when(F.col("p_partkey") % 3 > 0, "Action: ").otherwise(""), "p_name", F.lit("|rest|"))
    return table(spark, sf_dir, "part").select("p_partkey", text.between_markers(said).alias("found"))


@query("decode_bins", "SELECT p_partkey, CAST(k AS INT) AS k, CAST(j AS INT) AS dim, round(CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE ((p_size + 2 * k + j) % 256) / 256.0 * 2.0 - 1.0 END, 6) AS v FROM part, (SELECT unnest(range(3)) AS k), (SELECT unnest(range(2)) AS j)")
def decode_bins(spark, sf_dir):
    n = F.when(F.col("p_partkey") % 4 == 0, 4).otherwise(7)
    tokens = F.transform(F.sequence(F.lit(0), n), lambda i: (F.col("p_size") + i) % 256)
    out = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.decode_bins(tokens, 3, 2)).alias("k", "_s"))
    return exploded(out, "_s", "p_partkey", "k")


@query("attn_mask_block", f"""WITH {EV}, m AS (SELECT episode, t, CASE WHEN t >= 3 THEN 1 ELSE 0 END AS ar, value >= 0 OR t < 6 AS ok FROM ev), c AS (SELECT *, sum(ar) OVER (PARTITION BY episode ORDER BY t) AS s FROM m)
 SELECT a.episode, CAST(a.t AS INT) AS i, CAST(b.t AS INT) AS j, b.s <= a.s AND a.ok AND b.ok AS visible FROM c a JOIN c b ON a.episode = b.episode""")
def attn_mask_block(spark, sf_dir):
    rows = ev_frames(spark, sf_dir).select("episode", "t", (F.col("t") >= 3).alias("ar"), ((F.col("value") >= 0) | (F.col("t") < 6)).alias("ok"))
    return sequence.attention(rows, "episode", "t", "ar", "ok")


@query("positions", f"WITH {EV} SELECT episode, t, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY t) - 1 AS INT) AS position FROM ev")
def positions(spark, sf_dir):
    rows = ev_frames(spark, sf_dir).groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"] >= 50).alias("ok"))
    return rows.select("episode", F.posexplode(text.positions(F.col("ok"))).alias("t", "position"))


@query("next_token", f"WITH {EV} SELECT episode, t, event_id AS input, target FROM (SELECT *, lead(event_id) OVER (PARTITION BY episode ORDER BY t) AS target FROM ev) WHERE target IS NOT NULL")
def next_token(spark, sf_dir):
    rows = ev_frames(spark, sf_dir).groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda x: x["event_id"]).alias("ids"))
    inputs, targets = text.next_token(F.col("ids"))
    return rows.select("episode", F.posexplode(F.arrays_zip(inputs.alias("input"), targets.alias("target"))).alias("t", "_z")).select("episode", "t", "_z.input", "_z.target")


@query("right_align", "SELECT p_partkey, CAST(i AS INT) AS place, CAST((i + s) % 8 AS INT) AS v FROM (SELECT p_partkey, (p_size % 8 + 1) % 8 AS s FROM part), (SELECT unnest(range(8)) AS i)")
def right_align(spark, sf_dir):
    x = F.sequence(F.lit(0), F.lit(7))
    valid = F.transform(x, lambda i: i <= F.col("p_size") % 8)
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.right_align(x, valid)).alias("place", "v"))


@query("scatter", "SELECT p_partkey, CAST(i AS INT) AS place, CAST(CASE WHEN i = p_size % 6 THEN 100 ELSE i END AS INT) AS v FROM part, (SELECT unnest(range(6)) AS i)")
def scatter(spark, sf_dir):
    x = F.sequence(F.lit(0), F.lit(5))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.scatter(x, F.array((F.col("p_size") % 6).cast("int")), F.array(F.lit(100)))).alias("place", "v"))


@query("image_geometry", """SELECT p_partkey, CAST(floor(h / r) AS INT) AS rh, CAST(floor(w / r) AS INT) AS rw, CAST(greatest(0, floor((224 - floor(h / r)) / 2)) AS INT) AS top, CAST(greatest(0, floor((224 - floor(w / r)) / 2)) AS INT) AS left
 FROM (SELECT *, greatest(w / 224.0, h / 224.0) AS r FROM (SELECT p_partkey, CAST(p_size * 10 + 16 AS DOUBLE) AS h, CAST(p_partkey % 640 + 32 AS DOUBLE) AS w FROM part))""")
def image_geometry(spark, sf_dir):
    g = images.padded_geometry(F.col("p_size") * 10 + 16, F.col("p_partkey") % 640 + 32, 224, 224)
    return table(spark, sf_dir, "part").select("p_partkey", *(v.alias(k) for k, v in g.items()))


def _images(spark, sf_dir) -> DataFrame:
    size = F.col("p_size") % 9 + 4
    data = F.to_binary(F.repeat(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), (size * 6 * 3).cast("int")), F.lit("hex"))
    # Few bytes are read for much work, so rows are dealt out before it.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    return parts.select("p_partkey", F.struct(data.alias("data"), size.cast("int").alias("h"), F.lit(6).alias("w"), F.lit(3).alias("c")).alias("image"))


@query("image_resize_pad")
def image_resize_pad(spark, sf_dir):
    out = _images(spark, sf_dir).select("p_partkey", images.resize_with_pad(F.col("image"), 16, 16).alias("y"))
    return out.select("p_partkey", "y.h", "y.w", "y.c", F.sha2("y.data", 256).alias("digest"))


@query("image_augment")
def image_augment(spark, sf_dir):
    out = _images(spark, sf_dir).select("p_partkey", images.stack_kernel(lambda x: images.all_augmented(x, x.sum(axis=(1, 2, 3)).tolist()))(F.col("image")).alias("y"))
    return out.select("p_partkey", "y.h", "y.w", "y.c", F.sha2("y.data", 256).alias("digest"))


@query("wire_round_trip", f"WITH {LONG} SELECT episode, t, CAST(dim AS INT) AS dim, round(v, 6) AS v FROM lo")
def wire_round_trip(spark, sf_dir):
    return exploded(li_frames(spark, sf_dir).withColumn("y", wire.unpack_vector(wire.pack_vector(F.col("state")))), "y", "episode", "t")
