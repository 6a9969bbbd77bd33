"""Column sketches that are kept and merged when more rows arrive.

A sketch row holds what can be added up exactly (rows, present values, sum, least, greatest) and two
sketches of fixed size: one for distinct values, one for ranks.  Rows of the same column merge,
whatever part of the table each comes from, and the merged row is as good as one made from all rows:
a quantile is off by at most RANK_ERROR of the ranks, a distinct count by at most DISTINCT_ERROR
(three standard deviations).  A new file costs a scan of that file, never of the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import FLOATS, NUMBERS, number_of

RANK_SIZE, RANK_ERROR = 2048, 0.005
DISTINCT_SIZE, DISTINCT_ERROR = 12, 0.05
QUARTILES = (0.25, 0.5, 0.75)


def _told_apart(df: DataFrame, field: T.StructField) -> Column:
    """The value as the distinct sketch takes it; NaN is missing and both zeros are one."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.StringType, T.IntegerType, T.LongType)):
        return c
    if isinstance(field.dataType, FLOATS):
        return (number_of(df, field.name) + F.lit(0.0)).cast("string")
    return c.cast("string")


def column_sketches(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """`keys, position, name, rows, count, sum, min, max, distinct, ranks`: a row for each column, in one scan."""
    keys = list(keys)
    fields = [(i, f) for i, f in enumerate(f for f in df.schema.fields if f.name not in keys) if columns is None or f.name in columns]
    none = F.lit(None).cast("double")
    made = []
    for i, f in fields:
        number = number_of(df, f.name) if isinstance(f.dataType, NUMBERS) else None
        value = _told_apart(df, f)
        made.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                F.count(F.lit(1)).alias("rows"),
                F.count(value).alias("count"),
                (none if number is None else F.sum(number)).alias("sum"),
                (none if number is None else F.min(number)).alias("min"),
                (none if number is None else F.max(number)).alias("max"),
                F.hll_sketch_agg(value, DISTINCT_SIZE).alias("distinct"),
                (F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(number, RANK_SIZE)).alias("ranks"),
            ).alias(f"__s{i}")
        )
    wide = df.groupBy(*keys).agg(*made)
    return wide.select(*keys, F.inline(F.array(*[f"__s{i}" for i, _ in fields])))


def merged_sketches(sketches: DataFrame | Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """One row for each column of each key, from any number of sketch rows of it."""
    frames = [sketches] if isinstance(sketches, DataFrame) else list(sketches)
    return reduce(DataFrame.unionByName, frames).groupBy(*keys, "position", "name").agg(
        F.sum("rows").alias("rows"),
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def sketched_profile(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, missing and distinct values, sum, mean, extremes and quartiles that sketch rows stand for."""
    present = F.col("count") > 0
    measured = present & F.col("min").isNotNull()
    ranks = F.when(measured, F.col("ranks"))
    return sketches.select(
        *keys,
        "position",
        "name",
        F.col("rows").alias("row_count"),
        (F.col("rows") - F.col("count")).alias("missing_count"),
        F.when(present, F.hll_sketch_estimate("distinct")).otherwise(0).alias("unique_count"),
        "sum",
        (F.col("sum") / F.when(present, F.col("count"))).alias("mean"),
        "min",
        "max",
        *[F.kll_sketch_get_quantile_double(ranks, F.lit(q)).alias(n) for q, n in zip(QUARTILES, ("lower_quartile", "median", "upper_quartile"))],
    )
