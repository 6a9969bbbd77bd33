"""Benchmark cases from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_TYPE = "case_id string, category string, input string, expected string, metadata string"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """`case_id, category, input, expected, metadata` from files that hold a JSON array.

    The last three stay JSON text, whatever their shape; an absent one is `{}`.  A file is UTF-8 and
    one record: no JSON text holds the sign that would part records.  Read as many lines, Spark
    would go back to the file for every part that stays text.
    """
    read = spark.read.schema(CASE_TYPE).json(path, lineSep="\0")
    return read.select(
        "case_id",
        "category",
        *[F.coalesce(F.col(c), F.lit("{}")).alias(c) for c in ("input", "expected", "metadata")],
    )
