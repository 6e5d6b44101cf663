"""Registered queries of the engine's own operators, with their SQL.

Robot data is stood in for by the star schema: an order's lines are the frames of an episode with a state of four numbers, a user's events those of
one with a single number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import sequence

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")

# Common table expressions of the views below, for the SQL side.
LI = f"""li AS (SELECT l_orderkey AS episode, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS INT) AS t,
 l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS x FROM lineitem)"""
LONG = f"""{LI}, lo AS (SELECT episode, t, 0 AS dim, q AS v FROM li UNION ALL SELECT episode, t, 1, p FROM li
 UNION ALL SELECT episode, t, 2, d FROM li UNION ALL SELECT episode, t, 3, x FROM li)"""
EV = """ev AS (SELECT user_id AS episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
 event_id, ts, event_type, value FROM events)"""


def scrambled_sql(key: str, seed: int = 0) -> str:
    """sampling.scrambled in SQL."""
    x = f"((({key}) % 3000000000 * 2654435761 + {seed} * 40503) % 4294967296)"
    return f"((xor({x}, {x} >> 15) * 1540483477) % 4294967296)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, t, state of four numbers."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "episode")
    framed = sequence.step_index(lines, "episode", LINE_ORDER)
    return framed.select("episode", "t", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("state"))


def ev_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, t, event_id, ts, event_type, value."""
    framed = sequence.step_index(table(spark, sf_dir, "events").withColumnRenamed("user_id", "episode"), "episode", ("ts", "event_id"))
    return framed.select("episode", "t", "event_id", "ts", "event_type", "value")


def exploded(df: DataFrame, vector: str, *keys: str, digits: int = 6) -> DataFrame:
    """keys, dim, v rounded."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.round("v", digits))


def queries() -> dict[str, Query]:
    from trajecta.plans import queries_configs, queries_frames, queries_models, queries_rows, queries_serving, queries_sources, queries_timed, queries_vectors

    del queries_configs, queries_frames, queries_models, queries_rows, queries_serving, queries_sources, queries_timed, queries_vectors
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
