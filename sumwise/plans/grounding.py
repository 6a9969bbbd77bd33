"""What the hints of a table of requests refer to, joined to the requests once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import join_on, stored_together
from sumwise.functions.text import strip
from sumwise.operators.profile import missing_columns
from sumwise.operators.resolve import period_lookup, resolve_hints
from sumwise.operators.summary import STATS
from sumwise.plans.analysis import Analysis

NO_NAMES = "array<string>"


def given(hint: str | Column) -> Column:
    """Whether a hint was given at all; blanks count, the empty text does not."""
    c = F.col(hint) if isinstance(hint, str) else hint
    return F.coalesce(c != "", F.lit(False))


def distinct_hints(requests: DataFrame, keys: Sequence[str], hints: Sequence[str]) -> DataFrame:
    """`keys, __hint`: the distinct trimmed hints; repeats are dropped before the shuffle."""
    each = requests.select(*keys, F.explode(F.array(*hints)).alias("__hint"))
    return each.select(*keys, strip("__hint").alias("__hint")).where(F.col("__hint") != "").distinct()


def attach(df: DataFrame, lookup: DataFrame, on: dict[str, str | Column], name: str) -> DataFrame:
    """Left join of `lookup` as one struct column, where its columns equal those of `df`.

    `on` maps lookup columns to columns of `df`.  The struct is NULL where no row matched.
    A struct per lookup keeps the rows narrow: however many lookups a request needs, the
    generated code passes one value for each.
    """
    right = lookup.select(
        *[F.col(c).alias(f"__{name}_{c}") for c in on], F.struct(*lookup.columns).alias(name)
    )
    tests = [
        (F.col(ours) if isinstance(ours, str) else ours).eqNullSafe(F.col(f"__{name}_{theirs}"))
        for theirs, ours in on.items()
    ]
    kept = [*df.columns, name]
    return df.join(right, reduce(lambda a, b: a & b, tests, F.lit(True)), "left").select(*kept)


def missed(name: str) -> Column:
    return F.col(name).isNull()


def no_names() -> Column:
    return F.array().cast(NO_NAMES)


def one_column_summary(analysis: Analysis, keys: Sequence[str]) -> DataFrame:
    """The summary by column name; of columns that share a name, the first."""
    return analysis.numeric_summary.groupBy(*keys, F.col("name").alias("column")).agg(
        F.min_by(F.struct(*STATS), "position").alias("stats")
    )


def dataset_facts(analysis: Analysis) -> DataFrame:
    """One row per key: `series`, `trend`, `anomalies` and `missing` as structs.

    `series` has the column it was built from and its lowest and highest point; it and
    the next two are NULL where there is no series.
    """
    keys = list(analysis.keys)
    point = [F.col("period"), F.col("value")]
    series = analysis.series.groupBy(*keys).agg(
        F.struct(
            F.first("column").alias("column"),
            F.min(F.struct(F.col("value").alias("rank"), *point)).alias("lowest"),
            F.min(F.struct((-F.col("value")).alias("rank"), *point)).alias("highest"),
        ).alias("series")
    )

    def packed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in [*keys, "column" if name != "missing" else ""]]
        return df.select(*keys, F.struct(*rest).alias(name))

    facts = packed(missing_columns(analysis.profile, keys), "missing")
    for part in (series, packed(analysis.trend, "trend"), packed(analysis.anomalies, "anomalies")):
        facts = join_on(facts, part, keys)
    return facts


def column_lookup(requests: DataFrame, analysis: Analysis) -> DataFrame:
    """What every distinct column hint means: `keys, __hint, reason, column, candidates, stats`."""
    keys = list(analysis.keys)
    columns = analysis.numeric_summary.select(*keys, "position", "name")
    found = resolve_hints(distinct_hints(requests, keys, ["column_hint"]), columns, keys)
    return join_on(found, one_column_summary(analysis, keys), [*keys, "column"])


def month_lookup(requests: DataFrame, analysis: Analysis, hints: Sequence[str]) -> DataFrame:
    """What every distinct period hint means: `keys, __hint, reason, period, candidates, value`."""
    keys = list(analysis.keys)
    found = period_lookup(distinct_hints(requests, keys, hints), analysis.series, keys)
    return join_on(found, analysis.series.select(*keys, "period", "value"), [*keys, "period"])


def ground(requests: DataFrame, analysis: Analysis, period_hints: Sequence[str]) -> DataFrame:
    """`requests` with `f` (facts of the dataset), `c` (column hint) and `at_<hint>`.

    The lookups hold one row per dataset or distinct hint.  They are written first, so
    that the one pass over the requests joins tables of known size.
    """
    keys = list(analysis.keys)
    own = {k: k for k in keys}
    facts, columns, months = stored_together(
        dataset_facts(analysis), column_lookup(requests, analysis), month_lookup(requests, analysis, period_hints)
    )
    out = attach(requests, facts, own, "f")
    out = attach(out, columns, {**own, "__hint": strip("column_hint")}, "c")
    for hint in period_hints:
        out = attach(out, months, {**own, "__hint": strip(hint)}, f"at_{hint}")
    return out


def no_series() -> Column:
    return F.col("f.series").isNull()


def column_reason() -> Column:
    return F.when(missed("c"), "column_not_found").otherwise(F.col("c.reason"))


def trend_reason() -> Column:
    """Why the column hint does not name the column of the series; NULL if it may."""
    mismatch = F.col("c.column") != F.col("f.series.column")
    return F.when(
        given("column_hint"),
        F.coalesce(column_reason(), F.when(mismatch, "column_series_mismatch")),
    )


def trend_column() -> Column:
    return F.when(given("column_hint"), F.col("c.column")).otherwise(F.col("f.series.column"))


def period_reason(hint: str) -> Column:
    return F.when(missed(f"at_{hint}"), "period_not_found").otherwise(F.col(f"at_{hint}.reason"))


def year_of(hint: str) -> Column:
    """The hint as a bare four-digit year, else NULL."""
    s = strip(hint)
    return F.when(s.rlike("^[0-9]{4}$"), s)
