"""Queries of frames by time, and of statistics in one pass. A conversation is an episode whose turns are frames of 10 a second, on a clock that jitters and
now and then is half a frame late; embeddings are vectors that come in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.operators import adaptive, sampling, sequence, timed
from trajecta.plans import pipeline, statistics
from trajecta.plans.catalog import query, scrambled_sql, table
from trajecta.sources import datasets
from trajecta.streaming import replay, sessions

FPS, HORIZON = 10, 6
CLOCK = """turn / 10e0 + ((conv_id * 7 + turn * 13) % 5 - 2) * 4e-5 + CASE WHEN (conv_id * 31 + turn) % 9 = 0 THEN 5e-2 ELSE 0e0 END"""
CV = f"""cv AS (SELECT conv_id AS episode, turn AS t, {CLOCK} AS ts, CAST(length(text) AS BIGINT) AS v, role FROM conversations), ends AS (SELECT episode, max(ts) AS last, arg_max(v, ts) AS v FROM cv GROUP BY episode),
 asked AS (SELECT a.episode, a.t, k.k, a.ts + k.k / 10e0 AS q, e.last, e.v AS last_v FROM cv a JOIN ends e ON e.episode = a.episode, (SELECT unnest(range({HORIZON})) AS k) k),
 hit AS (SELECT q.*, b.ts IS NOT NULL AS hit, b.v FROM asked q LEFT JOIN cv b ON b.episode = q.episode AND abs(b.ts - q.q) <= 1e-4)"""
FLAGS = "CAST(k AS INT) AS k, NOT hit AND q > last + 1e-4 AS is_pad, NOT hit AND q <= last + 1e-4 AS is_missing"


def cv_frames(spark, sf_dir):
    """episode, t, ts, v, role."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("t"), F.expr(CLOCK).alias("ts"), F.length("text").cast("long").alias("v"), "role")


def flat(df):
    """One row for each element of the chunks."""
    zipped = F.posexplode(F.arrays_zip("ahead", "is_pad", "is_missing")).alias("k", "_x")
    return df.select("episode", "t", zipped).select("episode", "t", "k", "_x.ahead", "_x.is_pad", "_x.is_missing")


@query("time_chunks", f"WITH {CV} SELECT episode, t, {FLAGS}, CASE WHEN hit THEN v WHEN q > last + 1e-4 THEN last_v END AS ahead FROM hit")
def time_chunks(spark, sf_dir):
    return flat(timed.time_chunks(cv_frames(spark, sf_dir), {"ahead": "v"}, "episode", "ts", HORIZON, FPS, miss="null", bucket=64))


@query("time_chunks_hold", f"""WITH {CV}, held AS (SELECT h.episode, h.t, h.k, arg_max(b.v, b.ts) AS held FROM hit h JOIN cv b ON b.episode = h.episode AND b.ts <= h.q + 1e-4 GROUP BY h.episode, h.t, h.k)
 SELECT hit.episode, hit.t, CAST(hit.k AS INT) AS k, NOT hit AND q > last + 1e-4 AS is_pad, NOT hit AND q <= last + 1e-4 AS is_missing, CASE WHEN hit THEN v WHEN q > last + 1e-4 THEN last_v ELSE held END AS ahead
 FROM hit JOIN held ON held.episode = hit.episode AND held.t = hit.t AND held.k = hit.k""")
def time_chunks_hold(spark, sf_dir):
    return flat(timed.time_chunks(cv_frames(spark, sf_dir), {"ahead": "v"}, "episode", "ts", HORIZON, FPS, miss="hold", bucket=64))


@query("out_of_sync", f"WITH {CV}, st AS (SELECT episode, t, ts - lag(ts) OVER (PARTITION BY episode ORDER BY ts) AS step FROM cv) SELECT episode, t, round(step, 6) AS step FROM st WHERE abs(step - 1 / 10e0) > 1e-4")
def out_of_sync(spark, sf_dir):
    return timed.out_of_sync(cv_frames(spark, sf_dir), "episode", "ts", FPS).select("episode", "t", F.round("step", 6).alias("step"))


@query("episode_dataset_chunks", f"WITH {CV} SELECT hit.episode, hit.t, {FLAGS}, CASE WHEN hit THEN hit.v WHEN q > last + 1e-4 THEN last_v END AS ahead, cv.role AS prompt FROM hit JOIN cv ON cv.episode = hit.episode AND cv.t = hit.t")
def episode_dataset_chunks(spark, sf_dir):
    """Written as an episode dataset with its rate and tasks, read back, chunked by time, and the prompt looked up by task."""
    frames = cv_frames(spark, sf_dir)
    tasks = frames.select(F.col("role").alias("task"), F.xxhash64("role").alias("task_index")).distinct()
    root = datasets.scratch(spark, "episodes")
    stored = frames.select(F.col("episode").alias("episode_index"), F.col("t").alias("frame_index"), F.col("ts").alias("timestamp"), F.col("v").alias("actions"), F.xxhash64("role").alias("task_index"))
    datasets.write_episodes(stored, root, FPS, tasks)
    read = datasets.training_frames(spark, root, HORIZON, miss="null", prompt_from_task=True)
    zipped = F.posexplode(F.arrays_zip("actions", "is_pad", "is_missing")).alias("k", "_x")
    read = read.select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("t"), "prompt", zipped)
    return read.select("episode", "t", "k", F.col("_x.actions").alias("ahead"), "_x.is_pad", "_x.is_missing", "prompt")


ADAPTIVE_BINS, ADAPTIVE_BATCH = 60, 100


def _grid(low: str, high: str) -> str:
    """Edges of equal bins, as numpy.linspace makes them."""
    return f"list_append(list_transform(range({ADAPTIVE_BINS}), lambda i: i * (({high} - ({low})) / {ADAPTIVE_BINS}) + ({low})), {high})"


def _place(edges: str, value: str) -> str:
    return f"greatest(0, least({ADAPTIVE_BINS - 1}, len(list_filter({edges}, lambda e: e <= {value})) - 1))"


def _moved(counts: str, old: str, new: str) -> str:
    """Counts by new bin: each old bin's go where its left edge lies."""
    to = f"list_transform(range(1, {ADAPTIVE_BINS + 1}), lambda j: {_place(new, f'{old}[j]')})"
    return f"list_transform(range({ADAPTIVE_BINS}), lambda b: list_sum(list_transform(list_zip({to}, {counts}), lambda z: CASE WHEN z[1] = b THEN z[2] ELSE 0 END)))"


def _level(source: str, out: str) -> str:
    """16 neighbouring states merged in order."""
    low, high = "least(f.low, t.low)", "greatest(f.high, t.high)"
    return f"""{out}_r AS (SELECT *, place // 16 AS up, row_number() OVER (PARTITION BY dim, place // 16 ORDER BY place) AS k FROM {source}),
 {out}_f AS (SELECT dim, up, k, low, high, edges, counts FROM {out}_r WHERE k = 1 UNION ALL
  SELECT dim, up, k, low, high, grid, list_transform(list_zip({_moved('a_counts', 'a_edges', 'grid')}, {_moved('b_counts', 'b_edges', 'grid')}), lambda z: z[1] + z[2]) FROM
  (SELECT f.dim, f.up, t.k, {low} AS low, {high} AS high, {_grid(low, high)} AS grid, f.edges AS a_edges, f.counts AS a_counts, t.edges AS b_edges, t.counts AS b_counts
   FROM {out}_f f JOIN {out}_r t ON t.dim = f.dim AND t.up = f.up AND t.k = f.k + 1)),
 {out} AS (SELECT dim, up AS place, low, high, edges, counts FROM {out}_f QUALIFY k = max(k) OVER (PARTITION BY dim, up))"""


def adaptive_sql(elements: str, columns: str) -> str:
    """The statistics of elements (place, dim, v) in a tree of at most 4096 batches; `columns` names the dimension."""
    return f"""WITH RECURSIVE el AS ({elements}),
 ex AS (SELECT place, dim, min(v) AS low, max(v) AS high, list(v) AS vs FROM el GROUP BY place, dim), ed AS (SELECT *, {_grid("low - 1e-10", "high + 1e-10")} AS edges FROM ex),
 s0 AS (SELECT place, dim, low, high, edges, list_transform(range({ADAPTIVE_BINS}), lambda b: CAST(len(list_filter(list_transform(vs, lambda v: {_place("edges", "v")}), lambda x: x = b)) AS HUGEINT)) AS counts FROM ed),
 {_level("s0", "s1")}, {_level("s1", "s2")}, {_level("s2", "s3")},
 tot AS (SELECT dim, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM el GROUP BY dim),
 run AS (SELECT dim, low, high, edges, unnest(range(1, {ADAPTIVE_BINS + 1})) AS b, list_sum(counts[1:unnest(range(1, {ADAPTIVE_BINS + 1}))]) AS c FROM s3)
 SELECT {columns}, any_value(tot.n) AS n, round(any_value(tot.mean), 6) AS mean, round(any_value(tot.std), 6) AS std, round(any_value(low), 6) AS min, round(any_value(high), 6) AS max,
 round(min(edges[b]) FILTER (c >= 0.01 * n), 6) AS q01, round(min(edges[b]) FILTER (c >= 0.99 * n), 6) AS q99 FROM run JOIN tot ON tot.dim = run.dim GROUP BY run.dim"""


ADAPTIVE_SQL = adaptive_sql(f"SELECT vec_id // {ADAPTIVE_BATCH} AS place, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings", "CAST(run.dim AS INT) AS dim")
ROUNDED = ("mean", "std", "min", "max", "q01", "q99")


@query("adaptive_stats", ADAPTIVE_SQL)
def adaptive_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("embedding", F.floor(F.col("vec_id") / ADAPTIVE_BATCH).alias("batch"))
    found = adaptive.statistics(rows, "embedding", datasets.scratch(spark, "histograms"), "batch", bins=ADAPTIVE_BINS)
    return found.select("dim", "n", *(F.round(c, 6).alias(c) for c in ROUNDED))


# One configuration of each family: action dimensions, and how many of them are relative to the state.
FAMILIES = {"flow_libero": (7, 6), "fast_droid_jointpos_polaris": (8, 7), "discrete_libero": (7, 0)}


def _family(number: int, dims: int, deltas: int) -> str:
    """Elements of a state of 8 and of two steps of actions; dimensions of a configuration and field are numbered together."""
    base = number * 1000
    return f"""SELECT vec_id // {ADAPTIVE_BATCH} AS place, {base} + d AS dim, CAST(embedding[d + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(8)) AS d)
 UNION ALL SELECT vec_id // {ADAPTIVE_BATCH}, {base + 100} + d, CAST(embedding[9 + s * {dims} + d] AS DOUBLE) - CASE WHEN d < {deltas} THEN CAST(embedding[d + 1] AS DOUBLE) ELSE 0e0 END FROM embeddings, (SELECT unnest(range({dims})) AS d), (SELECT unnest(range(2)) AS s)"""


CONFIG_SQL = adaptive_sql(
    " UNION ALL ".join(_family(i, *f) for i, f in enumerate(FAMILIES.values())),
    f"{list(FAMILIES)}[run.dim // 1000 + 1] AS config, CASE WHEN run.dim % 1000 < 100 THEN 'state' ELSE 'actions' END AS field, CAST(run.dim % 100 AS INT) AS dim",
)


@query("config_statistics", CONFIG_SQL)
def config_statistics(spark, sf_dir):
    """What scales state and actions of one configuration of each family: embeddings stand in for records, their first elements for the state."""
    rows, out = table(spark, sf_dir, "embeddings").withColumn("place", F.floor(F.col("vec_id") / ADAPTIVE_BATCH)), None
    for name, (dims, _) in FAMILIES.items():
        joints = F.slice("embedding", 1, 7).cast("array<double>")
        state = [joints.alias("joint_position"), F.get("embedding", F.lit(7)).cast("double").alias("gripper_position")] if "droid" in name else [F.slice("embedding", 1, 8).cast("array<double>").alias("state")]
        actions = F.array(*(F.slice("embedding", 9 + s * dims, dims).cast("array<double>") for s in range(2)))
        records = rows.select("place", *state, actions.alias("actions"))
        found = statistics.config_statistics(pipeline.config(name), records, datasets.scratch(spark, "histograms"), batch="place", bins=ADAPTIVE_BINS)
        found = found.select(F.lit(name).alias("config"), "field", "dim", "n", *(F.round(c, 6).alias(c) for c in ROUNDED))
        out = found if out is None else out.unionByName(found)
    return out


IDLE, WIDTH = 45, 3
SEEN = f"""seen AS (SELECT conv_id AS session, turn AS t, turn * 10 + (turn + conv_id) // 3 * 40 AS s FROM conversations), gaps AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY session ORDER BY s, t) >= {IDLE} THEN 1 ELSE 0 END AS g FROM seen),
 runs AS (SELECT *, sum(g) OVER (PARTITION BY session ORDER BY s, t) AS r FROM gaps), steps AS (SELECT session, t, row_number() OVER (PARTITION BY session, r ORDER BY s, t) - 1 AS step FROM runs)"""
NOISE = ", ".join(f"round({scrambled_sql(f'{scrambled_sql("session", 5)} + step * {WIDTH} + {k}', 6)} / 4294967296e0, 6) AS n{k}" for k in range(WIDTH))


def seen(spark, sf_dir):
    """session, t, ts: turns as requests of a session, some after a long silence."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("t"))
    return turns.withColumn("ts", F.timestamp_seconds(F.col("t") * 10 + F.floor((F.col("t") + F.col("session")) / 3) * 40 + 1_700_000_000))


def spread(df):
    return df.select("session", "t", "step", *(F.round(F.get("noise", F.lit(k)), 6).alias(f"n{k}") for k in range(WIDTH)))


@query("session_noise", f"WITH {SEEN} SELECT session, t, step, {NOISE} FROM steps")
def session_noise(spark, sf_dir):
    """Random numbers of sessions in a table, by session and step."""
    steps = sessions.numbered(seen(spark, sf_dir), "session", IDLE)
    return spread(steps.withColumn("noise", sessions.noise(F.col("session"), F.col("step"), WIDTH, 5)))


@query("streaming_session_noise", f"WITH {SEEN} SELECT session, t, step, {NOISE} FROM steps")
def streaming_session_noise(spark, sf_dir):
    """The same from a stream that is stopped and started again half way: steps go on where they were."""
    numbers = lambda rows: sessions.session_noise(rows.withWatermark("ts", "365 days"), "session", WIDTH, 5, IDLE)
    out = replay.run_bounded(seen(spark, sf_dir), numbers, (F.col("t") < 4, F.col("t") >= 4))
    return spread(out)


RANK = f"row_number() OVER (PARTITION BY conv_id ORDER BY {scrambled_sql(scrambled_sql('conv_id', 3) + ' + turn', 4)}, turn)"


@query("trajectory_sample", f"WITH d AS (SELECT conv_id, turn, length(text) % 4 <> 0 AS moves, {RANK} AS r FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS q FROM d WHERE r <= 4 AND moves) SELECT conv_id, turn FROM k WHERE q <= 3")
def trajectory_sample(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 4 != 0).alias("moves"))
    return sampling.trajectory_sample(turns, "conv_id", "turn", 3, "moves", seed=3).select("conv_id", "turn")


SUITES = list(sequence.SUITE_STEPS)


@query("suite_steps", f"WITH s AS (SELECT conv_id, turn, {SUITES}[conv_id % 5 + 1] AS suite FROM conversations), c AS (SELECT *, CASE suite WHEN 'libero_spatial' THEN 220 WHEN 'libero_object' THEN 280 WHEN 'libero_goal' THEN 300 WHEN 'libero_10' THEN 520 ELSE 400 END + 10 AS cap FROM s) SELECT conv_id, turn, suite, CAST(cap - turn AS BIGINT) AS left_over, turn >= 10 AND (turn - 10) % 5 = 0 AS plans FROM c WHERE turn < cap")
def suite_steps(spark, sf_dir):
    """Steps that a run executes under its suite's limit, how many are left, and those that plan anew."""
    suite = F.get(F.array(*map(F.lit, SUITES)), (F.col("conv_id") % 5).cast("int"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", suite.alias("suite")).withColumn("cap", sequence.suite_limit(F.col("suite")))
    return turns.where("turn < cap").select("conv_id", "turn", "suite", (F.col("cap") - F.col("turn")).cast("long").alias("left_over"), sequence.waiting(F.col("turn"))[1].alias("plans"))
