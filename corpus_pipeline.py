"""From raw documents to packed training sequences.

Stages, in this order: documents predicted toxic go; one document of each near-duplicate group
stays; documents that hold a benchmark item go; what is left is packed into sequences.  Each
stage works on all rows its predecessor kept.  All but the last return the columns of `docs`.

Rows whose id is null are kept or rejected like others; rows that repeat an id and its text stand
in one near-duplicate group with equal ids, so all of them stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumwise.functions.basics import stored
from sumwise.llm.common import table
from sumwise.llm.decontaminate import without_passages
from sumwise.llm.near_duplicates import without_near_duplicates
from sumwise.llm.packing import packed
from sumwise.llm.toxicity import without_toxic


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("packing", sequences),
]

#: SQL cannot express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
