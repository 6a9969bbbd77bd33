"""The first few values of every column in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import FLOATS, by_keys
from sumwise.functions.text import double_text
from sumwise.sources.order import scan_order


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text; missing values, NaN included, are NULL."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, FLOATS):
        return F.when(~F.isnan(c), double_text(c))
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(c, "SSSSSS")
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return c.cast("string")


def row_order(df: DataFrame, order_by: Sequence[str]) -> dict[str, Column]:
    """Names and values of what orders the rows: `order_by`, else their place in the files they come from."""
    return {f"__o{j}": c for j, c in enumerate([F.col(o) for o in order_by] or scan_order(df))}


def first_values(
    cells: DataFrame, keys: Sequence[str], order_by: Sequence[str], limit: int, fields: Sequence[str]
) -> DataFrame:
    """`keys, position, values`: the first `limit` cells of each column as a list of structs.

    `cells` has `keys, position, order_by, fields`, all columns below each other, so the table
    is read once whatever its width.  The rank filter is applied before the shuffle as well as
    after it: a task sends at most `limit` rows per key and column.
    """
    rank = F.row_number().over(by_keys([*keys, "position"], *order_by))
    rows = cells.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")
    ordered = F.array_sort(F.collect_list(F.struct(*order_by, *fields)))
    return rows.groupBy(*keys, "position").agg(
        F.transform(
            ordered, lambda r: r[fields[0]] if len(fields) == 1 else F.struct(*[r[f].alias(f) for f in fields])
        ).alias("values")
    )
