"""Exact copies of whole texts, frequent ones by a heavy-hitter split.

1. Every text becomes its SHA-256; (id, digest) is written once, texts are read once.
2. Each task keeps a Misra-Gries summary of COUNTERS digests.  Summaries merge by adding up, and
   a digest's sum falls short of its true count by at most rows / (COUNTERS + 1), so every digest
   with over rows / FREQUENT rows is among those whose sum exceeds the difference of the two.
3. The candidates are counted exactly, with the row that stays; those that prove frequent are
   the winners.  There are fewer than FREQUENT of them whatever the corpus, so they are broadcast
   and settle their rows where these are read.
4. The rest is shuffled by digest; no digest left has more than rows / FREQUENT rows.

Edge cases: a null text counts as empty, so empty and null texts are copies of one another.  The
row with the largest id stays; a null id is smaller than any other, and a group of null ids
only has a null `keep_id`.  Rows that repeat both the text and the id that stays are all marked
`kept`, as nothing tells them apart by id; `without_copies` leaves one of them.  Empty tables give
empty results; further columns are ignored by the report and kept by the filter, whatever their
names.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwise.functions.basics import stored

FREQUENT = 1000  # a digest is frequent with more than one row in so many
COUNTERS = 2 * FREQUENT


def unchanged(text: Column) -> Column:
    return text


def digest_of(text: Column, change: Callable[[Column], Column] = unchanged) -> Column:
    return F.unhex(F.sha2(change(F.coalesce(text.cast("string"), F.lit(""))), 256))


def merged(summaries: list[tuple[np.ndarray, np.ndarray]], counters: int) -> tuple[np.ndarray, np.ndarray]:
    """One Misra-Gries summary of several: counts add up, then the (counters + 1)-th largest is taken off all."""
    keys, back = np.unique(np.concatenate([k for k, _ in summaries]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([n for _, n in summaries]), len(keys)).astype(np.int64)
    if len(keys) > counters:
        counts -= np.partition(counts, -counters - 1)[-counters - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def summaries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """`digest`, n: a Misra-Gries summary of each task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            # A fixed width and a last byte that is not zero: numpy strips zeros at the end.
            keys = np.array([d + b"." for d in batch.column("digest").to_pylist()], "S33")
            if len(keys):
                now = np.unique(keys, return_counts=True)
                kept = merged([kept, now] if kept else [now], counters)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k[:32] for k in kept[0].tolist()], pa.binary()), pa.array(kept[1])], names=["digest", "n"])

    return digests.select("digest").mapInArrow(summed, "digest binary, n long")


def frequent_digests(rows: DataFrame, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """`digest`, keep_id, group_size of the digests with over 1 / `frequent` of all `rows` (id, digest)."""
    total = rows.count()
    enough = total / frequent - total / (counters + 1)
    likely = stored(summaries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > enough).select("digest"))
    counted = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return stored(counted.where(F.col("group_size") > total / frequent))


def exact_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text", change: Callable[[Column], Column] = unchanged, frequent: int = FREQUENT
) -> DataFrame:
    """`id`, keep_id, group_size, kept, text_sha256 of every row; texts are equal when identical after `change`."""
    rows = stored(docs.select(F.col(id).alias("id"), digest_of(F.col(text), change).alias("digest")))
    winners = frequent_digests(rows, frequent, 2 * frequent)
    same = Window.partitionBy("digest")
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest", "id", F.max("id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    return settled.select("digest", "id", "keep_id", "group_size").unionByName(rest).select(
        F.col("id").alias(id),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", change: Callable[[Column], Column] = unchanged) -> DataFrame:
    """One row of each group of equal texts, all columns: one with the largest id."""
    report = exact_copies(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "id", "text", change)
    stay = report.where("kept").select(F.col("id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct()
    found = docs.withColumn("__own", digest_of(F.col(text), change))
    found = found.join(stay, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left_semi")
    return found.dropDuplicates([id, "__own"]).drop("__own")
