"""One table of value counts, from which profile, cleaning report, summaries and series follow.

`value_counts` reads the table once: all columns below each other, equal cells of a column counted
before the shuffle, spread by value, and text parsed once for each distinct value.  It is written
to the shared folder, unless one result alone is wanted of it.  What else is wanted of the table weighs the values by how often they occur,
so no result reads or parses the raw cells again, and a value that fills half of the table is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import FLOATS, NUMBERS, TIMES, join_on, number_of, spread, stored
from sumwise.functions.periods import month_label
from sumwise.functions.text import read_cells
from sumwise.operators.dates import with_readings
from sumwise.operators.profile import date_cells, facts_header, with_header
from sumwise.operators.scan import running_total
from sumwise.operators.series import SERIES_TYPES, period_date
from sumwise.operators.summary import DATE_TYPES, STATS, SUMMARY_TYPES, date_facts, nothing

CELL = {"text": "string", "whole": "bigint", "number": "double", "moment": "timestamp_ntz", "other": "string", "month": "date"}
SERIES = -1  # the position of rows that pair a month with a measure


def _column_cell(df: DataFrame, field: T.StructField) -> dict[str, Column]:
    """The cell in the column of its family; numbers of other types are told apart by their text."""
    c, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.StringType):
        return {"text": c}
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return {"whole": c}
    if isinstance(kind, FLOATS):
        return {"number": number_of(df, field.name)}
    if isinstance(kind, TIMES):
        return {"moment": c}
    return {"other": c, **({"number": c.cast("double")} if isinstance(kind, NUMBERS) else {})}


def _counted(df: DataFrame, keys: list[str], cells: list[tuple[int, dict[str, Column]]]) -> DataFrame:
    """`keys, position`, CELL, `n, amount`: equal cells, by the families that occur; the others are NULL."""
    kinds = {**CELL, "amount": "double"}
    met = [name for name in kinds if any(name in cell for _, cell in cells)]
    absent = F.lit(None)
    made = [F.struct(F.lit(p).alias("position"), *[cell.get(m, absent).cast(kinds[m]).alias(m) for m in met]) for p, cell in cells]
    long = df.select(*keys, F.inline(F.array(*made)))
    by = [*keys, "position", *[m for m in met if m != "amount"]]
    amount = F.sum("amount") if "amount" in met else absent.cast("double")
    counted = spread(long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), amount.alias("amount")), *by)
    families = [F.col(name) if name in met else absent.cast(kind).alias(name) for name, kind in CELL.items()]
    return counted.select(*keys, "position", *families, "n", "amount")


@dataclass(frozen=True)
class ValueCounts:
    """`rows`: keys, position, the cell by family, n, amount, and for text what the cell holds."""

    rows: DataFrame
    source: DataFrame
    keys: list[str]
    measure: str | None = None
    kept: bool = True

    @property
    def fields(self) -> list[tuple[int, T.StructField]]:
        return list(enumerate(f for f in self.source.schema.fields if f.name not in self.keys))

    def of(self, *kinds: type) -> list[tuple[int, str]]:
        return [(i, f.name) for i, f in self.fields if isinstance(f.dataType, kinds)]

    @property
    def cells(self) -> DataFrame:
        return self.rows.where(F.col("position") >= 0)


def value_counts(
    df: DataFrame, keys: Sequence[str] = (), measure: str | None = None, period: str | None = None, kept: bool = True
) -> ValueCounts:
    """The counts of a table; with `measure` and `period` also what its monthly series needs.

    Counts that are not `kept` are for one result: they are not written, texts are read as dates only
    for facts, and every result counts again.
    """
    keys = list(keys)
    cells = [(i, _column_cell(df, f)) for i, f in enumerate(f for f in df.schema.fields if f.name not in keys)]
    if measure is not None and period is not None:
        month = F.trunc(period_date(df, period), "MM")
        if isinstance(df.schema[measure].dataType, T.StringType):
            cells.append((SERIES, {"month": month, "text": F.col(measure)}))
        else:
            cells.append((SERIES, {"month": month, "amount": number_of(df, measure)}))
    read = read_cells(_counted(df, keys, cells), {"text": "found"})
    found = F.struct(
        F.col("found.num").alias("num"),
        F.col("found.text").isNotNull().alias("stays_text"),
        F.col("found.type").alias("type"),
        F.col("found.was_changed").alias("was_changed"),
        F.col("found.is_ambiguous").alias("is_ambiguous"),
    )
    rows = read.withColumn("found", found)
    return ValueCounts(stored(with_readings(rows, "text", "read")) if kept else rows, df, keys, measure if period is not None else None, kept)


def _rows(test: Column | None = None) -> Column:
    n = F.col("n") if test is None else F.when(test, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0).cast("long"))


def _missing() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in CELL if c != "month"])


def _value() -> Column:
    """The number of a cell, whatever its column's type."""
    return F.coalesce(F.col("number"), F.col("whole").cast("double"), F.col("found.num"))


def column_facts_of(counts: ValueCounts) -> DataFrame:
    """As `profile.column_facts`."""
    moment = F.col("moment")
    cells = counts.cells if counts.kept else with_readings(counts.cells, "text", "read")
    timed = F.bool_or((F.hour(moment) != 0) | (F.minute(moment) != 0) | (F.floor(F.second(moment)) != 0))
    facts = cells.groupBy(*counts.keys, "position").agg(
        _rows().alias("row_count"),
        F.count_if(~_missing()).alias("unique_count"),
        _rows(_missing()).alias("missing_count"),
        date_cells(F.col("read"), _rows).alias("date_count"),
        _rows(F.col("found.type") == "currency").alias("currency_count"),
        _rows(F.col("found.type") == "percentage").alias("percentage_count"),
        F.coalesce(timed, F.lit(False)).alias("has_time"),
    )
    return with_header(facts, facts_header(counts.source, counts.fields), counts.keys)


def cleaning_counts_of(counts: ValueCounts) -> DataFrame:
    """As `clean.cleaning_report` without examples."""
    header = counts.source.sparkSession.createDataFrame([(i, f.name) for i, f in counts.fields], "position int, name string")
    report = counts.cells.groupBy(*counts.keys, "position").agg(
        _rows().alias("total"),
        _rows(F.col("found.was_changed")).alias("changed_count"),
        _rows(F.col("found.is_ambiguous")).alias("unresolved_count"),
        _rows(_missing()).alias("missing_count"),
    )
    shown = ["position", "name", "total", "changed_count", "unresolved_count", "missing_count"]
    return with_header(report, header, counts.keys).select(*counts.keys, *shown)


def numeric_summary_of(counts: ValueCounts) -> DataFrame:
    """As `summary.numeric_summary` with `clean_text`: weighted moments and ranks."""
    by = [*counts.keys, "position"]
    numbers, texts = counts.of(*NUMBERS), counts.of(T.StringType)
    if not numbers and not texts:
        return nothing(counts.source, counts.keys, SUMMARY_TYPES)
    wanted = F.col("position").isin([i for i, _ in [*numbers, *texts]])
    cells = counts.cells.where(wanted).select(*by, "n", _value().alias("v"), F.coalesce("found.stays_text", F.lit(False)).alias("t"))
    n, v = F.col("n"), F.col("v")
    first = stored(
        cells.groupBy(*by).agg(
            _rows(v.isNotNull()).alias("count"),
            _rows(v.isNull()).alias("missing_count"),
            F.sum(n * v).alias("sum"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.bool_or("t").alias("t"),
        ).where(~F.col("t"))
    )
    header = counts.source.sparkSession.createDataFrame([*numbers, *texts], "position int, name string")
    mean = F.col("sum") / F.when(F.col("count") > 0, F.col("count"))
    present = join_on(cells.where(v.isNotNull()).select(*by, "n", "v"), first.select(*by, "count", mean.alias("mean")), by, "inner")
    ranked = running_total(present, by, ["v"], "n")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__total") - n <= rank) & (rank < F.col("__total")), v))

    low, high = at(F.floor((F.col("count") - 1) / 2)), at(F.floor(F.col("count") / 2))
    square = F.sum(n * (v - F.col("mean")) * (v - F.col("mean")))
    rest = ranked.groupBy(*by).agg(
        ((low + high) / 2).alias("median"),
        F.when(F.first("count") > 1, F.sqrt(square / (F.first("count") - 1))).alias("std"),
    )
    summary = join_on(first, rest, by).withColumn("mean", mean)
    # One row per column of the table: its size is the width of the schema.
    if counts.keys:
        return summary.join(F.broadcast(header), "position").select(*by, "name", *STATS)
    always = F.col("position").isin([i for i, _ in numbers]) | F.col("t").isNotNull()
    filled = header.join(summary, "position", "left").where(always)
    return filled.select("position", "name", *STATS).na.fill(0, ["count", "missing_count"])


def date_summary_of(counts: ValueCounts) -> DataFrame:
    """As `summary.date_summary`."""
    dates = counts.of(*TIMES)
    if not dates:
        return nothing(counts.source, counts.keys, DATE_TYPES)
    moment = F.col("moment")
    facts = counts.cells.where(F.col("position").isin([i for i, _ in dates])).groupBy(*counts.keys, "position").agg(
        _rows().alias("__rows"), _rows(moment.isNotNull()).alias("count"), F.min(moment).alias("min"), F.max(moment).alias("max")
    )
    header = counts.source.sparkSession.createDataFrame(dates, "position int, name string")
    return date_facts(with_header(facts, header, counts.keys), counts.keys)


def monthly_series_of(counts: ValueCounts) -> DataFrame:
    """As `series.monthly_series` of the measure and period that were named."""
    if counts.measure is None:
        return nothing(counts.source, counts.keys, SERIES_TYPES)
    keys, pairs = counts.keys, counts.rows.where(F.col("position") == SERIES)
    name = F.lit(counts.measure).alias("column")
    if isinstance(counts.source.schema[counts.measure].dataType, T.StringType):
        value = F.sum(F.col("n") * F.col("found.num"))
        months = pairs.groupBy(*keys, "month").agg(F.coalesce(value, F.lit(0.0)).alias("value"), F.bool_or("found.stays_text").alias("__unread"))
        unread = months.where("__unread").select(*keys, F.lit(True).alias("__bad")).distinct()
        # Without keys one unreadable cell leaves no series at all.
        months = join_on(months, unread, keys, "left_anti") if keys else months.join(unread, how="left_anti")
    else:
        months = pairs.groupBy(*keys, "month").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("value"))
    return months.where(F.col("month").isNotNull()).select(*keys, name, month_label("month").alias("period"), "value")
