"""Helpers of the folder."""

import pyarrow as pa
from pyspark.sql import functions as F

from sumwise.llm.common import ascii_lower, slices, smallest


def test_smallest_is_the_same_as_sorting_all(spark):
    rows = spark.range(30_000)
    for most in (0, 7, 500, 40_000):
        got = [r.id for r in smallest(rows, F.xxhash64("id"), most).collect()]
        assert got == [r.id for r in rows.orderBy(F.xxhash64("id")).limit(most).collect()]


def test_slices_keep_all_rows_and_their_order():
    texts = ["a" * 5, None, "b" * 50, "", "c", "d" * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most in (1, 6, 10, 1000):
        parts = list(slices(iter([batch]), "text", most))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts
        filled = [[len(t) for t in p.column("text").to_pylist() if t] for p in parts]
        assert all(len(n) <= 1 or sum(n) <= most for n in filled)  # a longer text comes with empty ones at most
    assert list(slices(iter([batch.slice(0, 0)]), "text", 5)) == []


def test_only_ascii_is_lowered(spark):
    assert spark.createDataFrame([("AÉz",)], "t string").select(ascii_lower("t")).first()[0] == "aÉz"
