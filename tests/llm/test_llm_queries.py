"""The queries of this folder against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import corpus_pipeline
from sumwise.llm import queries
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert ordered(mine) == ordered(theirs)


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert all(callable(f) for _, f in corpus_pipeline.STAGES)
