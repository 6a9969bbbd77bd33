"""Calendar-month labels (`YYYY-MM`) and the ways people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwise.functions.basics import col
from sumwise.functions.text import WHITESPACE, ascii_digits, strip

STRICT_LABEL = r"^[0-9]{4}-[0-9]{2}$"

# Spellings of the months.
MONTHS = {
    "january": 1, "jan": 1,
    "february": 2, "feb": 2,
    "march": 3, "mar": 3,
    "april": 4, "apr": 4,
    "may": 5,
    "june": 6, "jun": 6,
    "july": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10,
    "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}


def month_label(date: Column | str) -> Column:
    return F.date_format(col(date), "yyyy-MM")


def month_number(token: Column | str) -> Column:
    """1-12 for a month name, its short form or its number; else NULL."""
    t = col(token)
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    digits = F.when(t.rlike("^0*([1-9]|1[0-2])$"), t.try_cast("int"))
    return F.coalesce(F.element_at(names, F.lower(t)), digits)


def hint_words(hint: Column | str) -> Column:
    return F.split(ascii_digits(strip(hint)), f"[{WHITESPACE}]+")


def month_and_year(hint: Column | str) -> Column:
    """Label for a two-word hint such as `March 2024` or `03 2024`; else NULL."""
    return month_and_year_of(hint_words(hint))


def month_and_year_of(words: Column) -> Column:
    """As `month_and_year`, for the words of a hint: they are read many times over."""
    year = F.try_element_at(words, F.lit(2))
    month = month_number(F.try_element_at(words, F.lit(1)))
    fits = (F.size(words) == 2) & year.rlike("^[0-9]{4}$") & month.isNotNull()
    return F.when(fits, F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def lone_month(hint: Column | str) -> Column:
    """Month number of a one-word hint such as `Mar` or `3`; else NULL."""
    return lone_month_of(hint_words(hint))


def lone_month_of(words: Column) -> Column:
    """As `lone_month`, for the words of a hint."""
    return F.when(F.size(words) == 1, month_number(F.try_element_at(words, F.lit(1))))


def month_of_label(label: Column | str) -> Column:
    """Month number of a strict `YYYY-MM` label; else NULL."""
    c = col(label)
    return F.when(c.rlike(STRICT_LABEL), F.substring(c, 6, 2).cast("int"))


def next_label(label: Column | str, months: Column | int) -> Column:
    """The label `months` later; NULL for a label that is not a month."""
    c = col(label)
    start = F.when(c.rlike(STRICT_LABEL), F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd"))
    return month_label(F.add_months(start, months if isinstance(months, Column) else F.lit(months)))
