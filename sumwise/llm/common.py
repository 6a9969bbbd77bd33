"""Helpers that several operators of this folder share."""

from __future__ import annotations

import string
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Made = TypeVar("Made")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """Only A-Z change, so that the length in bytes stays as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def smallest(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The `most` rows with the smallest `order`, a 64-bit hash of something unique.

    Every task sends its own smallest rows to the driver, so rows whose hash lies far above
    the expected limit are left out before; what is sent does not grow with the tasks then.
    """
    share = 2 * most / max(1, rows.count())
    if share < 1:
        rows = rows.where(order < int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(order).limit(most)


def per_worker(key: str, make: Callable[[], Made]) -> Made:
    """What `make` returns, made once in the life of a Python worker."""
    kept = sys.__dict__.setdefault("_sumwise_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `text`; a longer text comes with empty ones at most.

    Arrow batches are cut by rows, so a few very long texts could otherwise fill a worker.  At the
    end of a task the worker gives back what Arrow holds: it lives on, idle, beside later ones.
    """
    for batch in batches:
        ends = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = size = 0
        for row, n in enumerate(ends):
            if size and size + n > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
