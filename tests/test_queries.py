"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = [
    "monthly_series", "detect_trend", "iqr_summary", "numeric_summary", "table_profile", "claims_cause", "payload_facts",
    "analysis_results", "cleaning_examples_in_file_order", "column_candidates", "column_schema_in_file_order", "compare_periods_long",
    "dates_of_a_column", "explain_comparisons", "file_candidates", "iqr_summary_long", "load_cases", "load_workbooks", "numeric_summary_from_counts",
    "register_dataset", "rolling_mean_long", "semantic_candidates", "sketched_profile_bound", "workbook_columns",
]
SQL = spark_entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert ordered(mine) == ordered(theirs)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 5
