"""The analysis of one table or a stack of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import join_on, stored_together
from sumwise.operators.anomaly import iqr_summary
from sumwise.operators.clean import normalize_table
from sumwise.operators.profile import column_profile, missing_columns, profile_of, table_profile
from sumwise.operators.series import SERIES_TYPES, compare_periods, comparison_counts, detect_trend, monthly_series
from sumwise.operators.summary import date_summary, nothing, numeric_summary
from sumwise.operators.values import (
    ValueCounts,
    column_facts_of,
    date_summary_of,
    monthly_series_of,
    numeric_summary_of,
    value_counts,
)
from sumwise.sources.tables import as_json


@dataclass(frozen=True)
class Analysis:
    """The results for every key; each is a lazy DataFrame and costs nothing unused.

    `series` and what follows from it have rows only for keys whose period column could
    be read: a key without them has no trend.
    """

    keys: tuple[str, ...]
    shape: DataFrame
    profile: DataFrame
    cleaned: DataFrame
    numeric_summary: DataFrame
    date_summary: DataFrame
    series: DataFrame
    trend: DataFrame
    changes: DataFrame
    change_counts: DataFrame
    anomalies: DataFrame
    asked: tuple[DataFrame, str | None, str | None] | None = None  # table, measure, period

    def kept(self) -> Analysis:
        """The results later plans look things up in, written once to the shared folder.

        Of one table they follow from its value counts, for which it is read once.
        """
        if self.asked:
            df, value, period = self.asked
            return from_counts(self, value_counts(df, self.keys, value, period)).kept()
        profile, numbers, series = stored_together(self.profile, self.numeric_summary, self.series)
        return replace(
            self,
            profile=profile,
            numeric_summary=numbers,
            series=series,
            **from_series(series, self.keys),
        )

    @property
    def series_columns(self) -> DataFrame:
        """`keys, series_column`: the measure the series of a key was built from."""
        return self.series.groupBy(*self.keys).agg(F.first("column").alias("series_column"))


def analyze(
    df: DataFrame, keys: Sequence[str] = (), value: str | None = None, period: str | None = None
) -> Analysis:
    """Profile, cleaning and summaries, and with `value` and `period` also the monthly
    series with its trend, changes and anomalies."""
    keys = tuple(keys)
    if value is not None and period is not None:
        return replace(analysis_of(df, keys, monthly_series(df, period, value, keys)), asked=(df, value, period))
    return replace(analysis_of(df, keys, nothing(df, keys, SERIES_TYPES)), asked=(df, None, None))


def from_counts(analysis: Analysis, counts: ValueCounts) -> Analysis:
    """The same results, all but shape and cleaned table from one table of value counts."""
    series = monthly_series_of(counts)
    return replace(
        analysis,
        profile=profile_of(column_facts_of(counts), counts.keys),
        numeric_summary=numeric_summary_of(counts),
        date_summary=date_summary_of(counts),
        series=series,
        asked=None,
        **from_series(series, analysis.keys),
    )


def analysis_of(df: DataFrame, keys: Sequence[str], series: DataFrame) -> Analysis:
    keys = tuple(keys)
    return Analysis(
        keys=keys,
        shape=table_profile(df, keys),
        profile=column_profile(df, keys),
        cleaned=normalize_table(df, keys),
        numeric_summary=numeric_summary(df, keys, clean_text=True),
        date_summary=date_summary(df, keys),
        series=series,
        **from_series(series, keys),
    )


def from_series(series: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    by = [*keys, "column"]
    return {
        "trend": detect_trend(series, by),
        "changes": compare_periods(series, by),
        "change_counts": comparison_counts(series, by),
        "anomalies": iqr_summary(series, by, with_points=True),
    }


def _listed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str, name: str) -> DataFrame:
    """`keys, name`: the rows of one key as a list in order; rows are columns or months."""
    entry = F.struct(F.col(order).alias("__order"), F.struct(*fields).alias("row"))
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["row"]).alias(name)
    )


def analytics_payload(analysis: Analysis, with_profile: bool = False) -> DataFrame:
    """`keys, payload`: the results of a key as one JSON object, absent parts left out.

    The analysis needs a key; a single table gets one as a constant column.
    The default carries the summaries, trend, changes and anomalies; `with_profile` is
    the variant for questions: summary, profile, changes and anomalies.
    """
    keys = list(analysis.keys)
    stats = ["name", "count", "missing_count", "sum", "mean", "median", "min", "max", "std"]
    parts = [_listed(analysis.numeric_summary, keys, stats, "position", "numeric_summary")]
    if with_profile:
        shown = ["name", "dtype", "inferred_type", "unique_count", "missing_count", "missing_percentage"]
        parts.append(_listed(analysis.profile, keys, shown, "position", "profile"))
    else:
        dates = ["name", "count", "missing_count", "min", "max", "duration_days"]
        parts.append(_listed(analysis.date_summary, keys, dates, "position", "date_summary"))
        trend = [c for c in analysis.trend.columns if c not in [*keys, "column"]]
        parts.append(analysis.trend.select(*keys, F.struct(*trend).alias("trend")))
    steps = [c for c in analysis.changes.columns if c not in [*keys, "column"]]
    parts.append(_listed(analysis.changes, keys, steps, "to_period", "period_comparison"))
    found = [c for c in analysis.anomalies.columns if c not in [*keys, "column"]]
    parts.append(analysis.anomalies.select(*keys, F.struct(*found).alias("anomalies")))
    joined = parts[0]
    for part in parts[1:]:
        joined = join_on(joined, part, keys)
    return as_json(joined, keys, "payload")


def known_columns(analysis: Analysis) -> DataFrame:
    """The distinct names of the numeric columns."""
    return analysis.numeric_summary.select("name").distinct()


def known_labels(datasets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, label`: the distinct roles and display names of registered datasets."""
    roles = datasets.select(*keys, F.col("role").alias("label"))
    names = datasets.select(*keys, F.col("display_name").alias("label"))
    return roles.unionByName(names).where(F.col("label").isNotNull()).distinct()


def missing_values(analysis: Analysis) -> DataFrame:
    return missing_columns(analysis.profile, analysis.keys)
