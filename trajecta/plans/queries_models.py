"""Queries of hosted models and codebooks over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trajecta.functions import text, vector
from trajecta.operators import codebook
from trajecta.operators.stats import NormStats
from trajecta.plans.catalog import query, table
from trajecta.plans.host import Host
from trajecta.plans.pipeline import VOCABULARY, Config, Family, Model

H, D, N = 3, 6, 4
MEAN, STD, A_MEAN, A_STD = [0.01, -0.02, 0.03, 0.0], [0.5, 0.25, 1.0, 2.0], [0.1, 0.2, -0.3, 0.4], [1.0, 0.5, 2.0, 0.25]
WEIGHT = "((h * 7 + d * 3 + k * 5) % 11 - 5) / 10e0"


def linear():
    """A stand-in for a policy: actions that are linear in the state."""
    h, d, k = np.ogrid[:H, :D, :D]
    weight = ((h * 7 + d * 3 + k * 5) % 11 - 5) / 10.0
    return lambda state, tokens, mask, noise: np.einsum("hdk,nk->nhd", weight, state) + noise


_LIST = lambda v: "[" + ", ".join(f"{x}e0" for x in v) + "]"


@query(
    "policy_inference",
    f"""WITH z AS (SELECT vec_id, list_transform(range(1, {N + 1}), lambda i: CAST(embedding[i] AS DOUBLE)) AS s FROM embeddings), n AS (SELECT vec_id, s, list_transform(range(1, {N + 1}), lambda i: (s[i] - {_LIST(MEAN)}[i]) / ({_LIST(STD)}[i] + 1e-6)) AS z FROM z),
 a AS (SELECT vec_id, s, h, d, list_sum(list_transform(range({N}), lambda k: {WEIGHT} * z[k + 1])) AS a FROM n, (SELECT unnest(range({H})) AS h), (SELECT unnest(range({D})) AS d))
 SELECT vec_id, CAST(h AS INT) AS h, CAST(d AS INT) AS d, round(a * (coalesce({_LIST(A_STD)}[d + 1], 1e0) + 1e-6) + coalesce({_LIST(A_MEAN)}[d + 1], 0e0) + CASE WHEN d < 3 THEN s[d + 1] ELSE 0e0 END, 6) AS v FROM a""",
)
def policy_inference(spark, sf_dir):
    """Records prepared, put through a model in batches, and brought back: scaling, tokens, padding, and absolute actions."""
    config = Config("linear", None, Model(Family.FLOW, H, D, 16), delta=(3, -1), default_prompt="move")
    stats = {"state": NormStats(MEAN, STD), "actions": NormStats(A_MEAN, A_STD)}
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, N).cast("array<double>").alias("state"))
    out = Host(config, stats, linear).infer(rows)
    out = out.select("vec_id", F.posexplode("actions").alias("h", "_s")).select("vec_id", "h", F.posexplode("_s").alias("d", "v"))
    return out.withColumn("v", F.round("v", 6))


@query(
    "codebook_nearest",
    """WITH el AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, d, round(avg(v), 4) AS v FROM el GROUP BY label, d),
 c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS code, list(v ORDER BY d) AS c FROM m GROUP BY label), x AS (SELECT vec_id, code, list_distance(CAST(embedding AS DOUBLE[]), c) AS dist FROM embeddings, c)
 SELECT vec_id, CAST(arg_min(code, dist) AS INT) AS code, round(min(dist), 6) AS distance FROM x GROUP BY vec_id""",
)
def codebook_nearest(spark, sf_dir):
    """The labels' mean vectors, a row for each label, as a codebook."""
    rows = table(spark, sf_dir, "embeddings")
    elements = rows.select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("v"))
    means = elements.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("c")).orderBy("label").collect()
    return codebook.nearest(rows.select("vec_id", "embedding"), "embedding", np.array([r["c"] for r in means])).select("vec_id", "code", F.round("distance", 6).alias("distance"))


@query(
    "codebook_decode",
    """WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even((tanh(CAST(x AS DOUBLE)) + 1e0) * 31 / 2e0, 0) AS INT) / 31e0 * 2e0 - 1e0) AS v FROM embeddings),
 g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN list_transform(v, lambda x: 0e0) ELSE v END AS v FROM f)
 SELECT vec_id, CAST(i // 6 AS INT) AS h, CAST(i % 6 AS INT) AS d, round(v[i + 1], 6) AS v FROM g, (SELECT unnest(range(60)) AS i)""",
)
def codebook_decode(spark, sf_dir):
    """Vectors to codes of two dimensions each, to a model's output tokens, and back to actions; some outputs have no marker or a code that does not exist."""
    levels = codebook.bins("custom", 2**10)
    digits = F.transform("embedding", lambda x: vector.fsq_quantize(x.cast("double"), levels[0]))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.get("_d", k * 2) + F.get("_d", k * 2 + 1) * levels[0])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", digits.alias("_d")).select("vec_id", pairs.alias("_c"))
    codes = F.when(F.col("vec_id") % 11 == 0, F.concat("_c", F.array(F.lit(5000)))).otherwise(F.col("_c"))
    marker = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<int>")).otherwise(text.characters(F.lit("Action: ")))
    tokens = F.concat(text.characters(F.lit("yes. ")), marker, F.transform(codes, lambda c: text.remap(c, VOCABULARY).cast("int")), text.characters(F.lit("|")))
    made = codebook.actions(rows.select("vec_id", tokens.alias("tokens")), "tokens", codebook.grid(levels), VOCABULARY, 10, 6)
    out = made.select("vec_id", F.posexplode("actions").alias("h", "_s")).select("vec_id", "h", F.posexplode("_s").alias("d", "v"))
    return out.withColumn("v", F.round("v", 6))
