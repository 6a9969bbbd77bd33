"""Cleaning of text columns with a report of everything that stays unclear."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import join_on
from sumwise.functions.text import double_text, read_cells
from sumwise.operators.samples import first_values, row_order

MAX_EXAMPLES = 5


def text_columns(df: DataFrame, keys: Sequence[str] = ()) -> list[tuple[int, str]]:
    """(position, name) of the text columns; positions do not count the keys."""
    fields = [f for f in df.schema.fields if f.name not in keys]
    return [(i, f.name) for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]


def text_cells(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Every cell of every text column as a row: `keys, position, raw, found`.

    The rules are compiled once, however many text columns there are.
    """
    picked = [(i, c) for i, c in text_columns(df, keys) if columns is None or c in columns]
    wide = df.select(*keys, *[F.col(name).alias(str(i)) for i, name in picked])
    long = wide.unpivot(list(keys), [str(i) for i, _ in picked], "position", "raw")
    return read_cells(
        long.select(*keys, F.col("position").cast("int").alias("position"), "raw"), {"raw": "found"}
    )


def normalize_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every text column `c` becomes `c__num` and `c__text`; other columns stay as they are.

    A resolved number is in `c__num`; a date is ISO text; anything unclear keeps its raw
    text in `c__text`.  Column order is kept.
    """
    texts = {name: f"__found_{name}" for _, name in text_columns(df, keys)}
    found = read_cells(df, texts) if texts else df
    out = []
    for c in df.columns:
        if c in texts:
            out += [F.col(f"{texts[c]}.num").alias(f"{c}__num"), F.col(f"{texts[c]}.text").alias(f"{c}__text")]
        else:
            out.append(F.col(c))
    return found.select(*out)


def resolved_columns(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, position, all_resolved`: text columns whose every non-null cell is a number."""
    return (
        text_cells(df, keys)
        .groupBy(*keys, "position")
        .agg((F.count("found.text") == 0).alias("all_resolved"))
    )


def cleaned_table(df: DataFrame) -> DataFrame:
    """One table with final column types: double where every cell resolved, else text.

    Which columns these are depends on the data, so one flag per text column is fetched;
    nothing else leaves the executors.
    """
    texts = dict(text_columns(df))
    flags = {texts[r["position"]]: r["all_resolved"] for r in resolved_columns(df).collect()} if texts else {}
    wide = normalize_table(df)
    out = []
    for c in df.columns:
        if c not in texts.values():
            out.append(F.col(c))
        elif flags.get(c, True):
            out.append(F.col(f"{c}__num").alias(c))
        else:
            out.append(F.coalesce(F.col(f"{c}__text"), double_text(f"{c}__num")).alias(c))
    return wide.select(*out)


def cleaning_report(
    df: DataFrame,
    keys: Sequence[str] = (),
    order_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    most_examples: int = MAX_EXAMPLES,
) -> DataFrame:
    """Per column: total, changed, unresolved and missing cells, and the first unresolved ones.

    Numbers and dates are never touched and report zeros.  `order_by` says which examples are the
    first ones; without it the order of the files does, and a table without either has none,
    and with `most_examples` 0 none are sought.
    """
    keys = list(keys)
    fields = [f for f in df.schema.fields if f.name not in keys]
    picked = [(i, f) for i, f in enumerate(fields) if columns is None or f.name in columns]
    texts = [(i, f.name) for i, f in picked if isinstance(f.dataType, T.StringType)]
    typed = [(i, f) for i, f in picked if not isinstance(f.dataType, T.StringType)]

    parts = []
    if texts:
        parts.append(
            text_cells(df, keys, [name for _, name in texts])
            .groupBy(*keys, "position")
            .agg(
                F.count(F.lit(1)).alias("total"),
                F.count_if("found.was_changed").alias("changed_count"),
                F.count_if("found.is_ambiguous").alias("unresolved_count"),
                F.count_if(F.col("raw").isNull()).alias("missing_count"),
            )
        )
    if typed:
        lacking = [F.count_if(_is_missing(f)).alias(f"__m{i}") for i, f in typed]
        wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *lacking)
        zero = F.lit(0).cast("long")
        per_column = F.array(
            *[F.struct(F.lit(i).alias("position"), F.col(f"__m{i}").alias("n")) for i, _ in typed]
        )
        parts.append(
            wide.select(*keys, "total", F.explode(per_column).alias("c")).select(
                *keys,
                "c.position",
                "total",
                zero.alias("changed_count"),
                zero.alias("unresolved_count"),
                F.col("c.n").alias("missing_count"),
            )
        )
    counts = ["total", "changed_count", "unresolved_count", "missing_count"]
    header = df.sparkSession.createDataFrame([(i, f.name) for i, f in picked], "position int, name string")
    stacked = reduce(DataFrame.unionByName, parts)
    if keys:
        report = stacked.join(F.broadcast(header), "position")
    else:
        report = header.join(stacked, "position", "left").na.fill(0)
    report = report.select(*keys, "position", "name", *counts)
    order = row_order(df, order_by) if most_examples else {}
    if not order or not texts:
        return report
    unresolved = text_cells(df.withColumns(order), [*keys, *order], [name for _, name in texts]).where("found.is_ambiguous")
    unresolved = unresolved.select(*keys, "position", *order, "raw", "found.warning")
    examples = first_values(unresolved, keys, list(order), most_examples, ["raw", "warning"])
    return join_on(report, examples.withColumnRenamed("values", "__e"), [*keys, "position"]).select(
        *report.columns, F.coalesce("__e", F.array()).alias("unresolved_examples")
    )


def _is_missing(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
