"""Dates written in a way that only the column as a whole explains.

`03/04/2024` may be a day in March or in April; a column that also holds `13/04/2024` says which.
Every text is read by its shape, digits and letters apart: as a date that means the same either way
(`02-Jan-24`, `20240105`, `2024.1.5`), as day first, and as month first.  The order that explains
more of a column's cells wins; where both explain equally many, the column does not say, and such
cells stay text.  A cell alone is never decided by this.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import computed_once, join_on
from sumwise.functions.text import MAY_BE_MOMENT, ascii_digits, moment_of, strip

# Names of months, and the year from which two digits mean the last century.
MONTHS = "january february march april may june july august september october november december".split()
PIVOT = 69
TIME = r"(?:[T ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"
NUMBERS = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})" + TIME
YEAR_FIRST = r"^([0-9]{4})([/.-]?)([0-9]{2}|(?<=[/.-])[0-9]{1,2})\2([0-9]{2}|(?<=[/.-])[0-9]{1,2})" + TIME
NAMED = r"^([0-9]{1,2})([ /.-]?)([A-Za-z]{3,9})\.?,?\2([0-9]{4}|[0-9]{2})" + TIME
MAY_BE = r"^(?:[0-9]{1,4}[ /.-]|[0-9]{8}|[0-9]{1,2}[A-Za-z]|[A-Za-z]{3,9}\.?[ -][0-9])"  # the start of each of them
NAME_FIRST = r"^([A-Za-z]{3,9})(\.?[ -])([0-9]{1,2})(?:,? |-)([0-9]{4}|[0-9]{2})" + TIME


def _month_numbers() -> Column:
    names = [(n, i) for i, m in enumerate(MONTHS, 1) for n in {m, m[:3], *(["sept"] if i == 9 else [])}]
    return F.create_map(*[F.lit(x) for pair in names for x in pair])


def _moment(s: Column, pattern: str, year: Column, month: Column, day: Column) -> Column:
    """The moment of a text of the given shape, NULL where the parts are no date."""

    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    def time(group: int) -> Column:
        part = F.regexp_extract(s, pattern, group)
        return F.when(part == "", "00").otherwise(two(part))

    short = F.when(year.try_cast("int") < PIVOT, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    whole = F.when(F.length(year) == 2, short).otherwise(year)
    day_text = F.concat(whole, F.lit("-"), two(month), F.lit("-"), two(day))
    text = F.concat(day_text, F.lit(" "), time(5), F.lit(":"), time(6), F.lit(":"), time(7))
    return F.when(s.rlike(pattern), text.try_cast("timestamp_ntz"))


def date_readings(c: Column | str) -> Column:
    """`struct<sure, day_first, month_first>`: what a text means as a date, whatever the column says and if it says so."""
    return readings_of(ascii_digits(strip(c)))


def with_readings(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with `date_readings` of a column as `name`; each text is trimmed and read once."""
    bare = computed_once(df, df.columns, __bare=ascii_digits(strip(column)))
    return computed_once(bare, df.columns, **{name: readings_of(F.col("__bare"))})


def readings_of(s: Column) -> Column:
    """As `date_readings`, for a column already trimmed and in ASCII digits; NULL for most text that is no date."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    def named(name: Column) -> Column:
        return F.try_element_at(_month_numbers(), F.lower(name)).cast("string")

    known = moment_of(s)
    more = F.coalesce(
        _moment(s, YEAR_FIRST, part(YEAR_FIRST, 1), part(YEAR_FIRST, 3), part(YEAR_FIRST, 4)),
        _moment(s, NAMED, part(NAMED, 4), named(part(NAMED, 3)), part(NAMED, 1)),
        _moment(s, NAME_FIRST, part(NAME_FIRST, 4), named(part(NAME_FIRST, 1)), part(NAME_FIRST, 3)),
    )
    a, b, year = part(NUMBERS, 1), part(NUMBERS, 3), part(NUMBERS, 4)
    found = F.struct(
        F.coalesce(known, more).alias("sure"),
        _moment(s, NUMBERS, year, b, a).alias("day_first"),
        _moment(s, NUMBERS, year, a, b).alias("month_first"),
    )
    return F.when(s.rlike(f"{MAY_BE}|{MAY_BE_MOMENT}"), found)


def read_as(readings: Column, order: Column) -> Column:
    """The moment under the order of the column: `day_first`, `month_first` or NULL."""
    return F.coalesce(
        readings["sure"],
        F.when(order == "day_first", readings["day_first"]).when(order == "month_first", readings["month_first"]),
        # A day that is the same month (`05/05/2024`) needs no order.
        F.when(readings["day_first"] == readings["month_first"], readings["day_first"]),
    )


def order_of(day_first: Column, month_first: Column) -> Column:
    """The order that explains more cells; NULL where both explain equally many."""
    return F.when(day_first > month_first, "day_first").when(month_first > day_first, "month_first")


def date_orders(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, order, cells, dates`: how the dates of a text column are written, and how many cells that explains.

    Equal cells are counted before the shuffle and read once.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    read = with_readings(counted, "__t", "__r")
    n = F.col("__n")

    def cells(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    day, month = F.col("__r.day_first"), F.col("__r.month_first")
    facts = read.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("cells"),
        cells(F.col("__r.sure").isNotNull()).alias("__sure"),
        cells(day.isNotNull()).alias("__day"),
        cells(month.isNotNull()).alias("__month"),
        cells(day == month).alias("__same"),
    )
    order = order_of(F.col("__day"), F.col("__month"))
    dates = F.col("__sure") + F.when(order.isNull(), F.col("__same")).otherwise(F.greatest("__day", "__month"))
    return facts.select(*keys, order.alias("order"), "cells", dates.alias("dates"))


def with_dates(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` with the moments of a text column as `name`, each key read in its own order."""
    orders = date_orders(df, column, keys).select(*keys, F.col("order").alias("__order"))
    # Without keys there is a single order.
    joined = join_on(df, orders, keys) if keys else df.crossJoin(F.broadcast(orders))
    return joined.withColumn(name, read_as(date_readings(column), F.col("__order"))).drop("__order")
