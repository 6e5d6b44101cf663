"""Operators whose whole result SQL can express, against that SQL in DuckDB."""

import duckdb
import pytest

from tests.test_queries import canonical
from trajecta.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in want.description], want.fetchall())


def test_registry():
    assert set(queries.oracle_sql()) <= set(queries.queries())
