"""Summaries of numeric and date columns, one row per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import NUMBERS, TIMES, join_on, number_of
from sumwise.operators.clean import text_cells
from sumwise.operators.quantile import exact_medians, near_median

STATS = ["count", "missing_count", "sum", "mean", "median", "min", "max", "std"]

SUMMARY_TYPES = {"position": "int", "name": "string"} | {
    s: "bigint" if s.endswith("count") else "double" for s in STATS
}
DATE_TYPES = {
    "position": "int",
    "name": "string",
    "count": "bigint",
    "missing_count": "bigint",
    "min": "string",
    "max": "string",
    "duration_days": "bigint",
}


def nothing(df: DataFrame, keys: Sequence[str], types: dict[str, str]) -> DataFrame:
    """No rows, with the keys of `df` and columns of the given types."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in types.items()]
    return df.select(*keys, *empty).where(F.lit(False))


def numeric_columns(df: DataFrame, keys: Sequence[str] = ()) -> list[tuple[int, str]]:
    """(position, name) of the columns of a numeric type."""
    return [
        (i, f.name)
        for i, f in enumerate(f for f in df.schema.fields if f.name not in keys)
        if isinstance(f.dataType, NUMBERS)
    ]


def numeric_summary(
    df: DataFrame,
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    clean_text: bool = False,
    approx: bool = False,
) -> DataFrame:
    """Count, missing, sum, mean, median, min, max and sample deviation per numeric column.

    With `clean_text`, text columns whose every non-null cell reads as a number count as
    numeric too; that is decided per key from the data, in the same aggregation.
    `approx` trades the exact median for a sketch.
    """
    keys = list(keys)
    fields = [f for f in df.schema.fields if f.name not in keys]
    picked = [(i, f) for i, f in enumerate(fields) if columns is None or f.name in columns]
    numbers = [(i, f.name) for i, f in picked if isinstance(f.dataType, NUMBERS)]
    texts = [(i, f.name) for i, f in picked if clean_text and isinstance(f.dataType, T.StringType)]
    if not numbers and not texts:
        return nothing(df, keys, SUMMARY_TYPES)

    def stats(v: Column) -> list[Column]:
        median = F.percentile_approx(v, 0.5, 10_000) if approx else F.lit(None).cast("double")
        near = F.lit(None).cast("array<double>") if approx else near_median(v)
        return [
            F.count(v).alias("count"),
            (F.count(F.lit(1)) - F.count(v)).alias("missing_count"),
            F.sum(v).alias("sum"),
            F.avg(v).alias("mean"),
            median.alias("median"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.stddev_samp(v).alias("std"),
            near.alias("near"),
        ]

    parts, values = [], []
    if numbers:
        cells = df.select(*keys, *[number_of(df, name).alias(f"__v{i}") for i, name in numbers])
        wide = cells.groupBy(*keys).agg(*[F.struct(*stats(F.col(f"__v{i}"))).alias(f"__s{i}") for i, _ in numbers])
        per_column = F.array(
            *[F.struct(F.lit(i).alias("position"), F.col(f"__s{i}").alias("s")) for i, _ in numbers]
        )
        parts.append(
            wide.select(*keys, F.explode(per_column).alias("c")).select(
                *keys, "c.position", *[f"c.s.{x}" for x in [*STATS, "near"]]
            )
        )
        long = cells.select(*keys, *[F.col(f"__v{i}").alias(str(i)) for i, _ in numbers]).unpivot(
            keys, [str(i) for i, _ in numbers], "position", "value"
        )
        values.append(long.select(*keys, F.col("position").cast("int").alias("position"), "value"))
    if texts:
        cells = text_cells(df, keys, [name for _, name in texts])
        parts.append(
            cells.groupBy(*keys, "position")
            .agg(F.count("found.text").alias("__texts"), *stats(F.col("found.num")))
            .where(F.col("__texts") == 0)
            .drop("__texts")
        )
        values.append(cells.select(*keys, "position", F.col("found.num").alias("value")))

    header = df.sparkSession.createDataFrame(
        [(i, name) for i, name in [*numbers, *texts]], "position int, name string"
    )
    summary = reduce(DataFrame.unionByName, parts).join(F.broadcast(header), "position")
    if not approx:
        near = summary.select(*keys, "position", "count", "near")
        medians = exact_medians(reduce(DataFrame.unionByName, values), [*keys, "position"], near, few=not keys)
        summary = join_on(summary.drop("median"), medians, [*keys, "position"])
    return summary.select(*keys, "position", "name", *STATS)


def date_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, missing, first and last moment and whole days between, per date column.

    Only columns of a date type count; dates written as text do not.
    """
    keys = list(keys)
    fields = [f for f in df.schema.fields if f.name not in keys]
    dates = [(i, f.name) for i, f in enumerate(fields) if isinstance(f.dataType, TIMES)]
    if not dates:
        return nothing(df, keys, DATE_TYPES)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, name in dates:
        moment = F.col(name).cast("timestamp_ntz")
        exprs.append(
            F.struct(
                F.count(moment).alias("count"), F.min(moment).alias("min"), F.max(moment).alias("max")
            ).alias(f"__s{i}")
        )
    wide = df.groupBy(*keys).agg(*exprs)
    per_column = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.col(f"__s{i}").alias("s"))
            for i, name in dates
        ]
    )
    each = wide.select(*keys, "__rows", F.explode(per_column).alias("c"))
    return date_facts(each.select(*keys, "__rows", "c.position", "c.name", "c.s.*"), keys)


def date_facts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary from rows, present values, first and last moment of each column."""
    first, last = F.col("min"), F.col("max")
    return facts.select(
        *keys,
        "position",
        "name",
        "count",
        (F.col("__rows") - F.col("count")).alias("missing_count"),
        iso_text(first).alias("min"),
        iso_text(last).alias("max"),
        F.floor(F.timestamp_diff("MICROSECOND", first, last) / F.lit(86_400_000_000))
        .cast("long")
        .alias("duration_days"),
    )


def iso_text(moment) -> Column:
    """ISO text of a timestamp, with microseconds only where there are any."""
    micros = F.date_format(moment, "SSSSSS")
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
