"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from trajecta.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        found = duck.execute(sql)
        assert got == canonical([c[0] for c in found.description], found.fetchall())


def test_registry_matches():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
