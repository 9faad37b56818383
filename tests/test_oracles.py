"""Every engine query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodestone.plans import queries as engine

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_same_rows(spark, duck, name):
    df = engine.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    found = duck.execute(engine.SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert got == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(engine.QUERIES) == set(engine.SQL)
