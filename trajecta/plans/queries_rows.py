"""Queries of structure, predicates, summaries and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import text
from trajecta.operators import aggregates, sampling, stats, structure
from trajecta.plans.catalog import EV, LONG, ev_frames, li_frames, query, table
from trajecta.sources import datasets


def nested_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("state")).alias("obs"), F.col("o_custkey").alias("cust"))


@query("repack", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def repack(spark, sf_dir):
    out = structure.repack(nested_orders(spark, sf_dir), {"key": "obs/id", "x": {"y": "obs/state/price"}})
    return out.select(F.col("key").alias("id"), F.col("x.y").alias("price"))


@query("flatten_leaves", 'SELECT o_orderkey AS "obs/id", o_totalprice AS "obs/state/price", o_orderstatus AS "obs/state/status", o_custkey AS cust FROM orders')
def flatten_leaves(spark, sf_dir):
    return structure.flatten(nested_orders(spark, sf_dir))


@query("unflatten_leaves", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def unflatten_leaves(spark, sf_dir):
    back = structure.unflatten(structure.flatten(nested_orders(spark, sf_dir)))
    return back.select("obs.id", "obs.state.price")


@query("regex_rename", 'SELECT o_orderkey AS "in/id", o_totalprice AS "in/price", o_custkey AS cust FROM orders')
def regex_rename(spark, sf_dir):
    return structure.flatten(structure.rename(nested_orders(spark, sf_dir), {".*/status": None, "obs/(?:state/)?(.+)": r"in/\1"}))


@query("keyed_map", "SELECT o_orderkey AS id, round(o_totalprice * 2, 4) AS price FROM orders")
def keyed_map(spark, sf_dir):
    out = structure.keyed_map(nested_orders(spark, sf_dir), {"obs/state/price": 2.0}, lambda c, k: c * k, strict=True)
    return out.select("obs.id", F.round("obs.state.price", 4).alias("price"))


@query("default_prompt", "SELECT n_nationkey, 'pick up' AS prompt FROM nation")
def default_prompt(spark, sf_dir):
    return structure.default_column(table(spark, sf_dir, "nation").select("n_nationkey"), "prompt", "pick up")


@query("without_strings", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def without_strings(spark, sf_dir):
    return structure.without_strings(table(spark, sf_dir, "customer"))


@query("wide_to_long", f"WITH {LONG} SELECT episode, t, CASE dim WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS name, v AS value FROM lo")
def wide_to_long(spark, sf_dir):
    return structure.long(structure.wide(li_frames(spark, sf_dir), "state", list("abcd")), ["episode", "t"], list("abcd"))


@query("unbatch", f"WITH {EV} SELECT episode, t AS index, event_id FROM ev")
def unbatch(spark, sf_dir):
    return structure.unbatched(structure.batched(ev_frames(spark, sf_dir), "episode", "t", ["event_id"]), ["event_id"]).select("episode", "index", "event_id")


@query("size_checks", "SELECT vec_id, CAST(64 AS INT) AS n FROM embeddings")
def size_checks(spark, sf_dir):
    return structure.checked(table(spark, sf_dir, "embeddings"), {"embedding": 64}).select("vec_id", F.size("embedding").alias("n"))


@query("success_paths", "SELECT p_partkey FROM part WHERE p_type LIKE '%MALL%'")
def success_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").rlike("(?-s)^.*MALL.*$")).select("p_partkey")


@query("movement_enabled", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN true ELSE false END, true)")
def movement_enabled(spark, sf_dir):
    enabled = F.when(F.col("event_id") % 3 == 1, True).when(F.col("event_id") % 3 == 2, False)
    return table(spark, sf_dir, "events").where(F.coalesce(enabled, F.lit(True))).select("event_id")


@query("param_filters", "SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '.*(ECO|SMA).*') AND NOT regexp_full_match(p_type, 'ECON.*')")
def param_filters(spark, sf_dir):
    path = F.col("p_type")
    return table(spark, sf_dir, "part").where(path.rlike("^(?:.*(ECO|SMA).*)$") & ~path.rlike("^(?:ECON.*)$")).select("p_partkey")


@query("excluded_keys", "SELECT n_nationkey, CAST(1 AS INT) AS left_over FROM nation")
def excluded_keys(spark, sf_dir):
    cameras = F.create_map(F.lit("rgb"), F.col("n_name"), F.lit("depth_top"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(F.map_filter(cameras, lambda k, v: ~k.contains("depth"))).alias("left_over"))


@query("camera_split", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS wrist, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS exterior FROM nation")
def camera_split(spark, sf_dir):
    kinds = F.array(F.col("n_nationkey") % 2, F.lit(1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(F.filter(kinds, lambda k: k == 0)).alias("wrist"), F.size(F.filter(kinds, lambda k: k != 0)).alias("exterior"))


@query("checkpoint_names", "SELECT p_partkey FROM part WHERE regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'tmp_' || CAST(p_partkey AS VARCHAR) END, '[0-9]+')")
def checkpoint_names(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.concat(F.lit("tmp_"), key))
    return table(spark, sf_dir, "part").where(name.rlike("^[0-9]+$")).select("p_partkey")


@query("key_sets", "SELECT n_nationkey, CAST(n_nationkey % 2 AS INT) AS extra, n_nationkey % 2 = 0 AS subset FROM nation")
def key_sets(spark, sf_dir):
    given = F.array(F.lit("high"), F.when(F.col("n_nationkey") % 2 == 1, "odd").otherwise("low"))
    extra = F.size(F.array_except(given, F.array(F.lit("high"), F.lit("low"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", extra.alias("extra"), (extra == 0).alias("subset"))


@query("timing_percentiles", "SELECT event_type AS key, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in aggregates.PERCENTILES) + " FROM events GROUP BY event_type")
def timing_percentiles(spark, sf_dir):
    out = aggregates.timing_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("value").alias("ms")))
    return out.select("key", *(F.round(c, 4).alias(c) for c in out.columns if c != "key"))


@query("success_rollup", "SELECT event_type AS task, count(*) AS episodes, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS rate FROM events GROUP BY ROLLUP (event_type)")
def success_rollup(spark, sf_dir):
    out = aggregates.success_rates(table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), (F.col("value") > 50).alias("ok")), "task", "ok")
    return out.withColumn("rate", F.round("rate", 6))


@query("log_window_mean", 'SELECT CAST(ceil(event_id / 100.0) AS BIGINT) AS "window", round(avg(value), 5) AS value FROM events GROUP BY 1')
def log_window_mean(spark, sf_dir):
    return aggregates.interval_means(table(spark, sf_dir, "events"), "event_id", 100, "value").withColumn("value", F.round("value", 5))


@query("global_norm", "SELECT round(sqrt(sum(value * value)), 3) AS norm FROM events")
def global_norm(spark, sf_dir):
    return aggregates.global_norm(table(spark, sf_dir, "events"), "value").select(F.round("norm", 3).alias("norm"))


@query("masked_loss", "SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / greatest(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 1), 3) AS loss FROM events GROUP BY user_id")
def masked_loss(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(aggregates.masked_mean(F.col("value"), F.col("event_type") == "click"), 3).alias("loss"))


@query("squared_losses", "SELECT l_orderkey, round(avg(pow(l_quantity - l_linenumber, 2)), 4) AS mse, round(avg(abs(l_quantity - l_linenumber)), 4) AS mae FROM lineitem GROUP BY l_orderkey")
def squared_losses(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(aggregates.mean_square(a, b), 4).alias("mse"), F.round(aggregates.mean_absolute(a, b), 4).alias("mae"))


@query("mean_frequency", "SELECT user_id, round(1e6 / avg(gap), 5) AS hz FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events) GROUP BY user_id")
def mean_frequency(spark, sf_dir):
    out = aggregates.frequency(table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s")), "user_id", F.col("s"))
    return out.select("user_id", F.round(F.col("hz") * 1e6, 5).alias("hz"))


@query("parameter_ema", f"WITH {EV}, n AS (SELECT episode, max(t) AS m FROM ev GROUP BY episode) SELECT ev.episode, round(sum(value * CASE WHEN t = 0 THEN pow(0.9, m) ELSE 0.1 * pow(0.9, m - t) END), 4) AS ema FROM ev JOIN n ON ev.episode = n.episode GROUP BY ev.episode")
def parameter_ema(spark, sf_dir):
    return aggregates.moving_average(ev_frames(spark, sf_dir), "episode", "t", "value", 0.9).select("episode", F.round("ema", 4).alias("ema"))


@query("next_index", "SELECT max(o_orderkey) + 1 AS next FROM orders")
def next_index(spark, sf_dir):
    return aggregates.next_index(table(spark, sf_dir, "orders"), "o_orderkey")


@query("duplicate_names", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return aggregates.repeated_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "name")


@query("equal_lengths", "SELECT l_orderkey, min(l_linenumber) = max(l_linenumber) AS equal, CAST(max(l_linenumber) AS INT) AS length FROM lineitem GROUP BY l_orderkey")
def equal_lengths(spark, sf_dir):
    return aggregates.equal_lengths(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").withColumn("length", F.col("length").cast("int"))


@query("bool_reductions", 'SELECT user_id, bool_or(value > 95) AS "any", bool_and(value > 5) AS "all" FROM events GROUP BY user_id')
def bool_reductions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 95).alias("any"), F.bool_and(F.col("value") > 5).alias("all"))
    return rows


@query("max_reward", "SELECT user_id, max(value) AS reward FROM events GROUP BY user_id")
def max_reward(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("reward"))


@query("total_size", "SELECT source, sum(n_chars)::BIGINT AS size, count(*) AS files FROM documents GROUP BY source")
def total_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"), F.count(F.lit(1)).alias("files"))


@query("step_keys", f"WITH {EV} SELECT CAST(episode AS VARCHAR) || '--' || event_type || '--' || CAST(t AS VARCHAR) AS key FROM ev")
def step_keys(spark, sf_dir):
    return ev_frames(spark, sf_dir).select(text.step_key(F.col("episode").cast("string"), F.col("event_type"), F.col("t")).alias("key"))


@query("video_names", "SELECT o_orderkey, 'rollout_' || replace(o_orderpriority, ' ', '_') || '_' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderstatus = 'F' THEN '_success' ELSE '_failure' END || '.mp4' AS name FROM orders")
def video_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.video_name(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderstatus") == "F").alias("name"))


@query("episode_of_file", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS episode FROM part")
def episode_of_file(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.episode_of_file(F.concat(F.lit("metadata_"), F.col("p_partkey").cast("string"), F.lit(".json"))).alias("episode"))


@query("dates", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS midnight, strftime(o_orderdate, '%Y_%m_%d_%H:%M:%S') AS stamp FROM orders")
def dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(F.date_trunc("day", "o_orderdate")).alias("midnight"), F.date_format("o_orderdate", "yyyy_MM_dd_HH:mm:ss").alias("stamp"))


@query("json_stats_round_trip", f"WITH {LONG} SELECT CAST(dim AS INT) AS dim, round(avg(v), 2) AS mean FROM lo GROUP BY dim")
def json_stats_round_trip(spark, sf_dir):
    found = stats.collected(stats.norm_stats(stats.elements(li_frames(spark, sf_dir), F.col("state"), "state"), 500))
    back = stats.from_json(stats.to_json(found))["state"]
    return spark.createDataFrame([(i, round(v, 2)) for i, v in enumerate(back.mean)], "dim int, mean double")


@query("dataset_length", "SELECT count(*) AS frames, count(DISTINCT l_orderkey) AS episodes FROM lineitem")
def dataset_length(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("l_orderkey").alias("episodes"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


SYNTHETIC = "(((id * 1000003 + k) % 3000000000 * 2654435761 + {salt} * 97) % 4294967296 * 48271) % 2147483647"


@query("synthetic_rows", f"SELECT CAST(id AS BIGINT) AS id, CAST(k AS INT) AS dim, CAST(({SYNTHETIC.format(salt=sum(ord(c) * (i + 1) for i, c in enumerate('tokens')))}) % 2048 AS INT) AS token FROM (SELECT unnest(range(200)) AS id), (SELECT unnest(range(3)) AS k)")
def synthetic_rows(spark, sf_dir):
    return datasets.synthetic(spark, 200, {"tokens": ("int", 3)}).select("id", F.posexplode("tokens").alias("dim", "token"))


@query("sharded_mix_counts", "SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def sharded_mix_counts(spark, sf_dir):
    both = sampling.concatenated({n: table(spark, sf_dir, n).select(F.lit(1).alias("one")) for n in ("events", "orders")})
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
