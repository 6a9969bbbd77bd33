"""Change between two values, with the rules for missing and zero bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwise.functions.basics import as_number

CHANGE_TYPE = (
    "struct<previous: double, current: double, absolute_change: double, "
    "percentage_change: double, is_valid: boolean, reason: string>"
)


def change(previous: Column | str, current: Column | str) -> Column:
    """`struct` of both sides, absolute and percentage change, validity and reason.

    The percentage is relative to the signed previous value.  From zero only "no change"
    has a percentage.
    """
    p, c = as_number(previous), as_number(current)
    missing = p.isNull() | c.isNull()
    diff = c - p
    pct = F.when(missing, None).when((p == 0) & (c == 0), 0.0).when(
        p != 0, F.try_divide(diff, p) * 100
    )
    reason = F.when(missing, "missing_value").when((p == 0) & (c != 0), "division_by_zero")
    return F.struct(
        p.alias("previous"),
        c.alias("current"),
        diff.alias("absolute_change"),
        pct.alias("percentage_change"),
        reason.isNull().alias("is_valid"),
        reason.alias("reason"),
    )
