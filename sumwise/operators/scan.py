"""Positions, windows and running totals over one long series, in as many tasks as it has ranges.

A window without keys, or over one key that holds most rows, runs in one task.  Here the rows are
cut to ranges of the order, each range counts its rows, and the counts of the ranges before it
place every row: position = rows before the range + place in the range.  With positions known,
windows run on blocks of equal length; each block also gets the last rows of the block before,
which a frame that looks back needs.

What is stored once in the shared folder stays as it is when an executor is lost, so positions
never disagree between the steps.  Only one row for each range and key is added up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sumwise.functions.basics import by_keys, join_on, stored

BLOCK = 1 << 17
IN_RANGE = (1 << 33) - 1  # the part of the running number that counts within a task


def _ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """`rows` sorted into ranges, with `__range` and `__in`, the place in the range."""
    columns = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    dealt = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_RANGE))
    return stored(dealt.select("*", F.spark_partition_id().alias("__range"), number.alias("__in")))


def _before(parts: DataFrame, keys: Sequence[str], amount: str) -> Column:
    """Sum of `amount` over the earlier ranges of the same key; `parts` has a row for each range and key."""
    earlier = by_keys(keys, "__range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0))


def placed(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """`rows` with `__at`, the position in their key from 0, and `__n`, the rows of the key."""
    keys = list(keys)
    kept = _ranged(rows, keys, [order])
    parts = kept.groupBy(*keys, "__range").agg(F.min("__in").alias("__low"), F.count(F.lit(1)).alias("__here"))
    parts = stored(
        parts.select(
            *keys, "__range", "__low", _before(parts, keys, "__here").alias("__before"), F.sum("__here").over(by_keys(keys)).alias("__n")
        )
    )
    at = F.col("__before") + F.col("__in") - F.col("__low")
    return join_on(kept, parts, [*keys, "__range"]).select(*rows.columns, at.alias("__at"), "__n")


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: str) -> DataFrame:
    """`rows` with `__total`, the sum of `amount` up to and including each row."""
    keys = list(keys)
    kept = _ranged(rows, keys, order)
    parts = kept.groupBy(*keys, "__range").agg(F.sum(amount).alias("__here"))
    parts = parts.select(*keys, "__range", _before(parts, keys, "__here").alias("__before"))
    within = F.sum(amount).over(by_keys([*keys, "__range"], "__in"))
    return join_on(kept, parts, [*keys, "__range"]).select(*rows.columns, (F.col("__before") + within).alias("__total"))


@dataclass
class Steps:
    """Rows in order, what a window over them needs, and how to drop the rows that only serve windows."""

    rows: DataFrame
    window: WindowSpec
    position: Column  # from 1
    length: Column
    marks: list[str] = field(default_factory=list)

    def own(self, made: DataFrame) -> DataFrame:
        return made.where(F.col("__own")).drop(*self.marks) if self.marks else made


def steps(series: DataFrame, keys: Sequence[str], order: str, back: int, long: bool, block: int | None = None) -> Steps:
    """Rows of each key in order, for windows that look at most `back` rows back.

    Short series, one task for each, are the default; `long` series are cut to blocks.  What is
    made from `rows` must carry the `marks` and go through `own`.
    """
    if not long:
        w = by_keys(keys, order)
        return Steps(series, w, F.row_number().over(w), F.count(F.lit(1)).over(by_keys(keys)))
    size = max(block or BLOCK, back)
    number = F.floor(F.col("__at") / size)
    near = (F.col("__at") % size >= size - back) & (F.col("__at") + 1 < F.col("__n"))
    blocks = F.when(near, F.array(number, number + 1)).otherwise(F.array(number))
    rows = placed(series, keys, order).select("*", F.posexplode(blocks).alias("__copy", "__block")).withColumn("__own", F.col("__copy") == 0)
    return Steps(rows, by_keys([*keys, "__block"], "__at"), (F.col("__at") + 1).cast("int"), F.col("__n"), ["__own"])
