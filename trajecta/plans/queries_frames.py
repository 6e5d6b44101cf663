"""Queries of sequences, lookups, sampling and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.operators import lookup, sampling, sequence
from trajecta.plans.catalog import EV, LI, ev_frames, li_frames, query, scrambled_sql, table
from trajecta.streaming import replay

IDLE_STEP = 60.0
IDLE = f"{EV}, fl AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY episode ORDER BY t)) < {IDLE_STEP}, false) AS idle FROM ev)"
RUNS = f"""{IDLE}, ch AS (SELECT *, CASE WHEN idle = lag(idle) OVER (PARTITION BY episode ORDER BY t) THEN 0 ELSE 1 END AS c FROM fl),
 rn AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY t) AS r FROM ch), il AS (SELECT episode, idle, min(t) AS s, max(t) + 1 AS e FROM rn GROUP BY episode, r, idle)"""
KEEP = f"""{RUNS}, gone AS (SELECT *, idle AND e - s >= 3 AS g FROM il), nb AS (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY s) AS k FROM gone),
 kp AS (SELECT episode, min(s) AS s, max(e) AS e FROM nb WHERE NOT g GROUP BY episode, k), kr AS (SELECT episode, CAST(s AS INT) AS s, CAST(e - 2 AS INT) AS e FROM kp WHERE e - s >= 6)"""


def flagged(spark, sf_dir):
    return ev_frames(spark, sf_dir).withColumn("idle", sequence.idle(F.array("value"), "episode", "t", IDLE_STEP))


def ranges(spark, sf_dir):
    return sequence.keep_ranges(flagged(spark, sf_dir), "idle", "episode", "t", 3, 6, 2)


@query("step_index", f"WITH {EV} SELECT episode, t, event_id FROM ev")
def step_index(spark, sf_dir):
    return ev_frames(spark, sf_dir).select("episode", "t", "event_id")


@query("idle_flags", f"WITH {IDLE} SELECT episode, t, idle FROM fl")
def idle_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("episode", "t", "idle")


@query("idle_islands", f"WITH {RUNS} SELECT episode, idle, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\" FROM il")
def idle_islands(spark, sf_dir):
    return sequence.islands(flagged(spark, sf_dir), "idle", "episode", "t").select("episode", "idle", "start", "end")


@query("keep_ranges", f"WITH {KEEP} SELECT episode, s AS start, e AS \"end\" FROM kr")
def keep_ranges(spark, sf_dir):
    return ranges(spark, sf_dir)


@query("frame_filter_semi", f"WITH {KEEP} SELECT episode, t, event_id FROM ev WHERE EXISTS (SELECT 1 FROM kr WHERE kr.episode = ev.episode AND t >= s AND t < e)")
def frame_filter_semi(spark, sf_dir):
    return lookup.frame_filter(ev_frames(spark, sf_dir).select("episode", "t", "event_id"), ranges(spark, sf_dir), "episode", "t")


@query("frame_filter_after_chunk", f"WITH {KEEP} SELECT ev.episode, ev.t, b.event_id AS ahead FROM ev JOIN (SELECT episode, max(t) AS m FROM ev GROUP BY episode) l ON l.episode = ev.episode JOIN ev b ON b.episode = ev.episode AND b.t = least(ev.t + 3, m) WHERE EXISTS (SELECT 1 FROM kr WHERE kr.episode = ev.episode AND ev.t >= s AND ev.t < e)")
def frame_filter_after_chunk(spark, sf_dir):
    frames = ev_frames(spark, sf_dir)
    chunked = frames.select("episode", "t", F.get(sequence.chunk(F.col("event_id"), "episode", "t", 4), F.lit(3)).alias("ahead"))
    return lookup.frame_filter(chunked, ranges(spark, sf_dir), "episode", "t")


@query("frame_filter_flags", f"WITH {KEEP} SELECT episode, t, EXISTS (SELECT 1 FROM kr WHERE kr.episode = ev.episode AND t >= s AND t < e) AS passes_filter FROM ev")
def frame_filter_flags(spark, sf_dir):
    return lookup.frame_flags(ev_frames(spark, sf_dir).select("episode", "t"), ranges(spark, sf_dir), "episode", "t")


@query("chunk_replay", f"WITH {EV} SELECT a.episode, a.t, CAST(a.t // 5 * 5 AS INT) AS query, CAST(a.t % 5 AS INT) AS place, b.value + CAST(a.t // 5 * 5 AS INT) * 1000 AS action FROM ev a JOIN ev b ON a.episode = b.episode AND b.t = a.t")
def chunk_replay(spark, sf_dir):
    """A chunk's elements bear the step that it was queried at, so that one from another chunk would show."""
    frames = ev_frames(spark, sf_dir)
    query_step, place = sequence.replay(F.col("t"), 5)
    placed = frames.select("episode", "t", query_step.alias("query"), place.alias("place"))
    chunks = frames.select(F.col("episode").alias("_e"), F.col("t").alias("_t"), F.transform(sequence.chunk(F.col("value"), "episode", "t", 5), lambda v: v + F.col("t") * 1000).alias("_c")).where("_t % 5 = 0")
    return placed.join(chunks, (F.col("episode") == F.col("_e")) & (F.col("query") == F.col("_t"))).select("episode", "t", "query", "place", F.get("_c", F.col("place")).alias("action"))


@query("replan_steps", f"WITH {EV} SELECT episode, t, t < 10 AS waits, t >= 10 AND (t - 10) % 5 = 0 AS plans FROM ev WHERE t <= 30")
def replan_steps(spark, sf_dir):
    waits, plans = sequence.waiting(F.col("t"))
    return ev_frames(spark, sf_dir).where(sequence.within_limit(F.col("t"), 30)).select("episode", "t", waits.alias("waits"), plans.alias("plans"))


@query("previous_total", f"WITH {EV} SELECT episode, t, lag(value) OVER (PARTITION BY episode ORDER BY t) AS previous FROM ev")
def previous_total(spark, sf_dir):
    return ev_frames(spark, sf_dir).select("episode", "t", sequence.previous(F.col("value"), "episode", "t").alias("previous"))


@query("ring_buffer", f"WITH {EV} SELECT episode, t, CAST(count(*) OVER w AS INT) AS held, min(event_id) OVER w AS low FROM ev WINDOW w AS (PARTITION BY episode ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def ring_buffer(spark, sf_dir):
    held = sequence.last_n(F.col("event_id"), "episode", "t", 10)
    return ev_frames(spark, sf_dir).select("episode", "t", F.size(held).alias("held"), F.array_min(held).alias("low"))


@query("camera_prefix", f"WITH {EV}, b AS (SELECT *, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY t) AS bad FROM ev) SELECT episode, t, event_id FROM b WHERE bad = 0")
def camera_prefix(spark, sf_dir):
    frames = ev_frames(spark, sf_dir).withColumn("ok", F.col("value") >= 5)
    return sequence.prefix_complete(frames, "ok", "episode", "t").select("episode", "t", "event_id")


@query("prompt_from_task", "SELECT c_custkey, n_name AS prompt FROM customer JOIN nation ON c_nationkey = n_nationkey")
def prompt_from_task(spark, sf_dir):
    return lookup.required(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "n_name", "prompt").select("c_custkey", "prompt")


@query("annotation_default", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'Do something') AS instruction FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def annotation_default(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string"))
    return lookup.optional(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", "quality", "instruction", "Do something").select("doc_id", "instruction")


@query("resume_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return lookup.unfinished(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("param_merge", """WITH ld AS (SELECT 'm/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, p_retailprice AS value FROM part WHERE p_partkey % 2 = 0),
 rf AS (SELECT 'm/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, 'float32' AS dtype, 0.0 AS value FROM part WHERE p_partkey % 3 = 0)
 SELECT rf.path, dtype, ld.value FROM ld JOIN rf ON ld.path = rf.path UNION ALL SELECT path, dtype, CAST(value AS DOUBLE) FROM rf WHERE path NOT IN (SELECT path FROM ld) AND regexp_full_match(path, '.*3.*')""")
def param_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("path", F.concat_ws("/", F.lit("m"), "p_brand", F.col("p_partkey").cast("string")))
    loaded = part.where("p_partkey % 2 = 0").select("path", F.lit("float64").alias("dtype"), F.col("p_retailprice").alias("value"))
    reference = part.where("p_partkey % 3 = 0").select("path", F.lit("float32").alias("dtype"), F.lit(0.0).alias("value"))
    return lookup.parameter_merge(loaded, reference, ".*3.*")


@query("tree_intersection", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def tree_intersection(spark, sf_dir):
    return lookup.intersection(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey").distinct(), "c_custkey")


@query("latest_reading", """SELECT c.event_id, (SELECT r.value FROM events r WHERE r.user_id = c.user_id AND r.event_type = 'view' AND r.ts <= c.ts ORDER BY r.ts DESC, r.event_id DESC LIMIT 1) AS seen FROM events c WHERE c.event_type = 'click'""")
def latest_reading(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return lookup.latest(clicks, events.where("event_type = 'view'"), "user_id", "ts", "value", "seen").select("event_id", "seen")


KNOWN = ["click", "view", "purchase", "signup", "logout"]


@query("nearest_config", "SELECT n_nationkey, (SELECT k FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'logout']) AS k) ORDER BY levenshtein(n_name, k), k LIMIT 1) AS nearest FROM nation")
def nearest_config(spark, sf_dir):
    return lookup.nearest_name(table(spark, sf_dir, "nation"), "n_name", KNOWN, "nearest").select("n_nationkey", "nearest")


@query("camera_names", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'hand' WHEN 1 THEN 'left' ELSE NULL END AS camera FROM nation")
def camera_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", lookup.named((F.col("n_nationkey") % 3).cast("string"), {"0": "hand", "1": "left"}).alias("camera"))


@query("stale_cache", "SELECT p_partkey, CASE WHEN starts_with(p_type, 'ECONOMY') THEN p_partkey <= 50 WHEN regexp_matches(p_type, '^(ECO|STA)') THEN p_partkey <= 100 ELSE false END AS stale FROM part")
def stale_cache(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lookup.stale(F.col("p_type"), F.col("p_partkey"), [("ECONOMY", 50), ("ECO|STA", 100)]).alias("stale"))


@query("asset_fallback", "SELECT s_suppkey, coalesce(c_name, 'none') AS asset FROM supplier LEFT JOIN customer ON c_custkey = coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END, s_suppkey * 100000)")
def asset_fallback(spark, sf_dir):
    keyed = table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")), F.col("s_suppkey") * 100_000).alias("key"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return lookup.optional(keyed, names, "key", "c_name", "asset", "none").select("s_suppkey", "asset")


POSITION = f"ps AS (SELECT event_id, row_number() OVER (ORDER BY {scrambled_sql('event_id', 7)}, event_id) - 1 AS position FROM events)"
PLAIN = "ps AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events)"


def shuffled(spark, sf_dir, seed=7):
    return sampling.positioned(table(spark, sf_dir, "events").select("event_id"), "event_id", seed)


@query("shuffle_order", f"WITH {POSITION} SELECT event_id, CAST(position AS BIGINT) AS position FROM ps")
def shuffle_order(spark, sf_dir):
    return shuffled(spark, sf_dir)


@query("batch_drop_last", f"WITH {PLAIN} SELECT event_id, CAST(position // 64 AS BIGINT) AS batch_id FROM ps WHERE position // 64 < (SELECT count(*) FROM events) // 64")
def batch_drop_last(spark, sf_dir):
    return sampling.batches(shuffled(spark, sf_dir, None), "position", 64).select("event_id", "batch_id")


@query("batch_keep_tail", f"WITH {PLAIN} SELECT event_id, CAST(position // 64 AS BIGINT) AS batch_id FROM ps")
def batch_keep_tail(spark, sf_dir):
    return sampling.batches(shuffled(spark, sf_dir, None), "position", 64, drop_last=False).select("event_id", "batch_id")


@query("batch_stacked", f"WITH {PLAIN} SELECT CAST(position // 64 AS BIGINT) AS batch_id, CAST(count(*) AS INT) AS size, min(event_id) AS first FROM ps GROUP BY 1")
def batch_stacked(spark, sf_dir):
    from trajecta.operators.structure import batched

    rows = sampling.batches(shuffled(spark, sf_dir, None), "position", 64, drop_last=False)
    return batched(rows, "batch_id", "position", ["event_id"]).select("batch_id", F.size("event_id").alias("size"), F.get("event_id", F.lit(0)).alias("first"))


@query("epoch_cycle", f"WITH {PLAIN}, n AS (SELECT count(*) // 200 AS n FROM events), b AS (SELECT event_id, position // 200 AS batch_id, n FROM ps, n WHERE position // 200 < n) SELECT CAST(r * n + batch_id AS BIGINT) AS step, event_id FROM b, (SELECT unnest(range(10)) AS r) WHERE r * n + batch_id < 10")
def epoch_cycle(spark, sf_dir):
    rows = sampling.batches(shuffled(spark, sf_dir, None), "position", 200)
    return sampling.epochs(rows, "batch_id", None, 10).select("step", "event_id")


@query("max_frames", f"WITH {POSITION} SELECT event_id FROM ps WHERE position < 500 // 64 * 64")
def max_frames(spark, sf_dir):
    return sampling.truncated(shuffled(spark, sf_dir), "position", 500, 64).select("event_id")


@query("weighted_mix", f"SELECT 'events' AS source, event_id AS id FROM events UNION ALL SELECT 'documents', doc_id FROM documents WHERE {scrambled_sql('doc_id', 3)} / 4294967296.0 < 0.25 / 0.75")
def weighted_mix(spark, sf_dir):
    parts = {"events": (table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 0.75), "documents": (table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 0.25)}
    return sampling.mixed(parts, "id", 3).select("source", "id")


@query("union_sources", "SELECT 'customer' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part")
def union_sources(spark, sf_dir):
    return sampling.concatenated({n: table(spark, sf_dir, n).select(F.col(c).alias("id")) for n, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))}).select("source", "id")


@query("step_subset", f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {scrambled_sql('event_id', 5)}, event_id) AS r FROM events) WHERE r <= 8")
def step_subset(spark, sf_dir):
    return sampling.step_subset(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 8, 5)


@query("instruction_choice", f"SELECT o_orderkey, CASE {scrambled_sql('o_orderkey', 1)} % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE 'none' END AS instruction FROM orders")
def instruction_choice(spark, sf_dir):
    options = F.array("o_orderstatus", "o_orderpriority", F.lit("none"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.chosen(F.col("o_orderkey"), options, 1).alias("instruction"))


@query("shard_rank", f"WITH {POSITION} SELECT event_id FROM ps WHERE position < (SELECT count(*) FROM events) // 3 * 3 AND position % 3 = 1")
def shard_rank(spark, sf_dir):
    return sampling.sharded(shuffled(spark, sf_dir), "position", 1, 3).select("event_id")


@query("retention", "SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def retention(spark, sf_dir):
    return sampling.retained(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("save_steps", "SELECT event_id FROM events WHERE (event_id % 100 = 0 AND event_id > 200) OR event_id = 777")
def save_steps(spark, sf_dir):
    return table(spark, sf_dir, "events").where(sampling.saves(F.col("event_id"), 100, 200, 777)).select("event_id")


@query("divisible_axis", "SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 AND (p_partkey % 4 > 0 OR p_size > p_partkey) THEN 0 WHEN p_partkey % 4 = 0 THEN 1 END AS INT) AS axis FROM part")
def divisible_axis(spark, sf_dir):
    shape = F.array(F.col("p_size").cast("long"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", sampling.largest_divisible(shape, 4).cast("int").alias("axis"))


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("chunk_window_equals_array", f"WITH {LI}, ends AS (SELECT episode, max(t) AS m FROM li GROUP BY episode), k AS (SELECT unnest(range(4)) AS k) SELECT a.episode, a.t, CAST(k.k AS INT) AS k, b.p AS by_window, b.p AS by_array FROM li a JOIN ends e ON e.episode = a.episode, k, li b WHERE b.episode = a.episode AND b.t = least(a.t + k.k, e.m)")
def chunk_window_equals_array(spark, sf_dir):
    frames = li_frames(spark, sf_dir).select("episode", "t", F.get("state", F.lit(1)).alias("v"))
    ahead = frames.withColumn("a", sequence.chunk(F.col("v"), "episode", "t", 4))
    whole = frames.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("_all"))
    both = ahead.join(whole, "episode").select("episode", "t", F.posexplode(F.arrays_zip(F.col("a").alias("by_window"), sequence.chunk_array(F.col("_all"), F.col("t"), 4).alias("by_array"))).alias("k", "_x"))
    return both.select("episode", "t", "k", "_x.by_window", "_x.by_array")


@query("streaming_chunk_replay", f"WITH {EV} SELECT episode, t, CAST(t // 5 * 5 AS INT) AS query, CAST(t % 5 AS INT) AS place, value + CAST(t // 5 * 5 AS INT) * 1000 AS action FROM ev")
def streaming_chunk_replay(spark, sf_dir):
    """The stateful form over a bounded file source, run to its end; frames and results are tables in the shared folder."""
    chunk = F.transform(sequence.chunk(F.col("value"), "episode", "t", 5), lambda v: v + F.col("t") * 1000)
    frames = ev_frames(spark, sf_dir).select("episode", "t", chunk.alias("chunk"))
    return replay.run_bounded(frames, lambda steps: replay.chunk_replay(steps, 5))


@query("streaming_lifecycle", f"WITH {EV} SELECT episode, t, CAST(t + 1 AS INT) AS steps, t = 6 AS last FROM ev WHERE t <= 6")
def streaming_lifecycle(spark, sf_dir):
    steps = ev_frames(spark, sf_dir).select("episode", "t", F.lit(False).alias("complete"))
    return replay.run_bounded(steps, lambda rows: replay.lifecycle(rows, 6))
