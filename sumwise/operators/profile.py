"""Profiles: table shape, duplicates, and per column type, distinct and missing values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import FLOATS, NUMBERS, TIMES
from sumwise.functions.text import read_cells
from sumwise.operators.dates import date_readings, with_readings

DATE_SHARE = 0.8


def table_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row and column count, emptiness, and rows that repeat an earlier one.

    Equal rows are counted where they are read before they are shuffled, so many copies
    of one row cost no more than one.
    """
    keys = list(keys)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    total = F.coalesce(F.sum("__n"), F.lit(0))
    return rows.groupBy(*keys).agg(
        total.alias("row_count"),
        F.lit(len(df.columns) - len(keys)).alias("column_count"),
        (total == 0).alias("is_empty"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def duplicate_column_names(catalog: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Names that several columns of one table share; see `sources.tables.column_catalog`."""
    return (
        catalog.groupBy(*keys, "name").count().where(F.col("count") > 1).select(*keys, "name")
    )


def _families(fields: list[tuple[int, T.StructField]]) -> dict[str, list[tuple[int, T.StructField]]]:
    """Columns that can be compared as one type: their values share a shuffle."""
    out: dict[str, list[tuple[int, T.StructField]]] = {}
    for i, f in fields:
        kind = f.dataType
        if isinstance(kind, T.StringType):
            family = "string"
        elif isinstance(kind, (T.BooleanType, T.IntegralType)):
            family = "long"
        elif isinstance(kind, FLOATS):
            family = "double"
        elif isinstance(kind, TIMES):
            family = "timestamp_ntz"
        else:
            family = kind.simpleString()
        out.setdefault(family, []).append((i, f))
    return out


def column_facts(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, missing and distinct values, and what its text cells look like.

    Two aggregations: first by value, combined before the shuffle and spread by value, so
    neither a hot key nor a hot value meets in one task; then by column.  Text is parsed
    once per distinct value.  Facts nobody selects are pruned.
    """
    keys = list(keys)
    fields = [f for f in df.schema.fields if f.name not in keys]
    picked = [(i, f) for i, f in enumerate(fields) if columns is None or f.name in columns]
    parts = []
    for family, members in _families(picked).items():
        wide = df.select(*keys, *[F.col(f.name).cast(family).alias(str(i)) for i, f in members])
        names = [str(i) for i, _ in members]
        value = F.col("value")
        if family == "double":
            value = F.when(~F.isnan("value"), F.col("value"))
        counted = (
            wide.unpivot(keys, names, "position", "value")
            .select(*keys, F.col("position").cast("int").alias("position"), value.alias("value"))
            .groupBy(*keys, "position", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        n = F.col("n")
        none = F.lit(0).cast("long")

        def rows_where(test):
            return F.coalesce(F.sum(F.when(test, n)), none)

        dates = currency = percentage = none
        timed = F.lit(False)
        if family == "string":
            counted = with_readings(read_cells(counted, {"value": "found"}), "value", "read")
            dates = date_cells(F.col("read"), rows_where)
            currency = rows_where(F.col("found.type") == "currency")
            percentage = rows_where(F.col("found.type") == "percentage")
        elif family == "timestamp_ntz":
            timed = F.coalesce(
                F.bool_or((F.hour("value") != 0) | (F.minute("value") != 0) | (F.floor(F.second("value")) != 0)),
                F.lit(False),
            )
        parts.append(
            counted.groupBy(*keys, "position").agg(
                F.sum("n").alias("row_count"),
                F.count("value").alias("unique_count"),
                rows_where(F.col("value").isNull()).alias("missing_count"),
                dates.alias("date_count"),
                currency.alias("currency_count"),
                percentage.alias("percentage_count"),
                timed.alias("has_time"),
            )
        )
    return with_header(reduce(DataFrame.unionByName, parts), facts_header(df, picked), keys)


def date_cells(read: Column, rows_where: Callable[[Column], Column]) -> Column:
    """Aggregate: the cells that are dates, in the order of day and month that the column itself tells."""
    day, month = rows_where(read["day_first"].isNotNull()), rows_where(read["month_first"].isNotNull())
    either = F.when(day == month, rows_where(read["day_first"] == read["month_first"])).otherwise(F.greatest(day, month))
    return rows_where(read["sure"].isNotNull()) + either


def facts_header(df: DataFrame, fields: Sequence[tuple[int, T.StructField]]) -> DataFrame:
    """One row per column of the table: its size is the width of the schema."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), _kind(f.dataType)) for i, f in fields],
        "position int, name string, dtype string, kind string",
    )


def with_header(facts: DataFrame, header: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`facts` of columns with what `header` says; without keys also of columns that have no rows."""
    if keys:
        return facts.join(F.broadcast(header), "position")
    return header.join(facts, "position", "left").na.fill(0).na.fill(False)


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, NUMBERS):
        return "numeric"
    if isinstance(kind, TIMES):
        return "date"
    return "text"


def inferred_type():
    """`numeric`, `date-like` or `text` from the facts of a column."""
    present = F.col("row_count") - F.col("missing_count")
    return (
        F.when(F.col("kind") == "numeric", "numeric")
        .when(F.col("kind") == "date", "date-like")
        .when((present > 0) & (F.col("date_count") / F.greatest(present, F.lit(1)) >= DATE_SHARE), "date-like")
        .otherwise("text")
    )


def column_profile(
    df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Per column: name, dtype, inferred type, distinct values, missing count and percentage.

    `approx` replaces the exact distinct counts, whose shuffle grows with the number of
    distinct values, by sketches.
    """
    return profile_of(_approx_facts(df, keys, columns) if approx else column_facts(df, keys, columns), keys)


def profile_of(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The profile that follows from the facts of the columns."""
    rows = F.col("row_count")
    return facts.select(
        *keys,
        "position",
        "name",
        "dtype",
        inferred_type().alias("inferred_type"),
        "unique_count",
        "missing_count",
        F.when(rows == 0, 0.0)
        .otherwise(F.col("missing_count") / F.greatest(rows, F.lit(1)) * 100)
        .alias("missing_percentage"),
    )


def _approx_facts(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    keys = list(keys)
    fields = [f for f in df.schema.fields if f.name not in keys]
    picked = [(i, f) for i, f in enumerate(fields) if columns is None or f.name in columns]
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in picked:
        c = F.col(f.name)
        if isinstance(f.dataType, FLOATS):
            c = F.when(~F.isnan(c), c)
        is_date = date_cells(date_readings(c), F.count_if) if isinstance(f.dataType, T.StringType) else F.lit(0)
        exprs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(_kind(f.dataType)).alias("kind"),
                F.approx_count_distinct(c).alias("unique_count"),
                F.count_if(c.isNull()).alias("missing_count"),
                is_date.cast("long").alias("date_count"),
            ).alias(f"__s{i}")
        )
    wide = df.groupBy(*keys).agg(*exprs)
    return wide.select(
        *keys, F.col("__rows").alias("row_count"), F.explode(F.array(*[f"__s{i}" for i, _ in picked])).alias("c")
    ).select(*keys, "row_count", "c.*")


def missing_columns(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The columns with missing values, in column order, and their number, per table."""
    lacking = F.when(
        F.col("missing_count") > 0, F.struct("position", "name", "missing_count", "missing_percentage")
    )
    return profile.groupBy(*keys).agg(
        F.count(lacking).alias("value"),
        F.transform(
            F.array_sort(F.collect_list(lacking)),
            lambda c: F.struct(
                c["name"].alias("name"),
                c["missing_count"].alias("missing_count"),
                c["missing_percentage"].alias("missing_percentage"),
            ),
        ).alias("columns"),
    )


def date_like_columns(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return profile.where(F.col("inferred_type") == "date-like").select(*keys, "position", "name")

