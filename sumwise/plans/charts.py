"""Tables ready to be drawn: one row per request with its points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import ASKED, computed_once, once_each
from sumwise.operators.anomaly import iqr_scores
from sumwise.plans.analysis import Analysis
from sumwise.plans.comparison import file_label
from sumwise.plans.grounding import (
    attach,
    column_reason,
    given,
    ground,
    missed,
    no_names,
    no_series,
    period_reason,
    trend_column,
    trend_reason,
    year_of,
)
from sumwise.plans.questions import QUESTION

# What can be charted.
CHARTS = {
    "trend_chart": "trend",
    "numeric_summary_chart": "numeric_summary",
    "period_change_chart": "period_change",
    "missing_values_chart": "missing_values",
}
SUMMARY_METRICS = ["sum", "mean", "median", "min", "max", "std", "count"]
POINTS = "array<struct<x: string, y: double, direction: string>>"


def _points(df: DataFrame, keys: Sequence[str], order: str, x: Column, y: Column, direction: Column) -> DataFrame:
    """`keys, points`: the months of a series or the columns of a table, in order."""
    entry = F.struct(
        F.col(order).alias("o"),
        F.struct(x.alias("x"), y.cast("double").alias("y"), direction.cast("string").alias("direction")).alias("p"),
    )
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["p"]).alias("points")
    )


def trend_points(analysis: Analysis) -> DataFrame:
    """Every month of a series with the direction of an anomaly."""
    keys = list(analysis.keys)
    scored = iqr_scores(analysis.series, [*keys, "column"])
    return _points(scored, keys, "period", F.col("period"), F.col("value"), F.col("direction"))


def change_points(analysis: Analysis) -> DataFrame:
    """Every transition of a series with its absolute change."""
    label = F.concat_ws(" → ", "from_period", "to_period")
    return _points(analysis.changes, analysis.keys, "to_period", label, F.col("absolute_change"), F.lit(None))


def missing_points(analysis: Analysis) -> DataFrame:
    """Every column with its share of missing values, in column order."""
    y = F.col("missing_percentage")
    return _points(analysis.profile, analysis.keys, "position", F.col("name"), y, F.lit(None))


def chart_specs(intents: DataFrame, analysis: Analysis, ids: Sequence[str] = ("request_id",)) -> DataFrame:
    """One chart per request: `found, reason, chart_type, column, metric, periods, points`.

    `intents` has `ids`, the keys of the analysis, `intent, column_hint, metric,
    period_hint, from_period_hint, to_period_hint`.  Every different chart of a dataset is
    made once, however many intents ask for it.
    """
    return once_each(intents, ids, [*analysis.keys, *QUESTION], lambda asked: _chart_specs(asked, analysis, [ASKED]))


def _chart_specs(intents: DataFrame, analysis: Analysis, ids: Sequence[str]) -> DataFrame:
    keys = list(analysis.keys)
    own = {k: k for k in keys}
    q = ground(intents, analysis, ["from_period_hint", "to_period_hint"])
    q = attach(q, trend_points(analysis), own, "t")
    q = attach(q, change_points(analysis), own, "d")
    q = attach(q, missing_points(analysis), own, "p")

    intent = F.col("intent")
    metric = F.coalesce("metric", F.lit("sum"))
    untrended = F.when(no_series(), "trend_not_computed")
    year = year_of("period_hint")
    in_year = F.filter("t.points", lambda p: p["x"].startswith(F.concat(year, F.lit("-"))))
    ranged = given("from_period_hint"), given("to_period_hint")
    pair_label = F.concat_ws(" → ", "at_from_period_hint.period", "at_to_period_hint.period")
    one_change = F.filter("d.points", lambda p: p["x"] == pair_label)

    reason = (
        F.when(
            intent == "trend_chart",
            F.coalesce(
                untrended,
                trend_reason(),
                F.when(given("period_hint") & year.isNotNull() & (F.size(in_year) == 0), "period_not_found"),
            ),
        )
        .when(
            intent == "numeric_summary_chart",
            F.coalesce(
                F.when(~given("column_hint"), "column_required"),
                column_reason(),
                F.when(~metric.isin(SUMMARY_METRICS), "unsupported_metric"),
            ),
        )
        .when(
            intent == "period_change_chart",
            F.coalesce(
                F.when(no_series(), "period_comparison_not_computed"),
                trend_reason(),
                F.when(ranged[0] != ranged[1], "period_range_incomplete"),
                F.when(
                    ranged[0],
                    F.coalesce(
                        period_reason("from_period_hint"),
                        period_reason("to_period_hint"),
                        F.when(
                            F.coalesce(F.size(one_change), F.lit(0)) == 0, "period_change_not_found"
                        ),
                    ),
                ),
            ),
        )
        .when(intent == "missing_values_chart", F.when(missed("p"), "profile_not_available"))
        .otherwise("unsupported")
    )
    q = computed_once(q, q.columns, reason=reason)
    ok = F.col("reason").isNull()

    def on(name: str) -> Column:
        return ok & (intent == name)

    by_metric = F.coalesce(*[F.when(metric == m, F.col(f"c.stats.{m}").cast("double")) for m in SUMMARY_METRICS])
    bar = F.array(
        F.struct(F.col("c.column").alias("x"), by_metric.alias("y"), F.lit(None).cast("string").alias("direction"))
    )
    points = (
        F.when(on("trend_chart"), F.when(year.isNotNull(), in_year).otherwise(F.col("t.points")))
        .when(on("numeric_summary_chart"), bar)
        .when(
            on("period_change_chart"),
            F.when(ranged[0], one_change).otherwise(F.coalesce("d.points", F.array().cast(POINTS))),
        )
        .when(on("missing_values_chart"), F.col("p.points"))
    )
    chart_type = F.coalesce(*[F.when(on(name), t) for name, t in CHARTS.items()])
    candidates = F.when(F.col("reason") == "ambiguous_column", F.col("c.candidates")).when(
        F.col("reason") == "ambiguous_period",
        F.when(F.col("at_from_period_hint.reason").isNotNull(), F.col("at_from_period_hint.candidates")).otherwise(
            F.col("at_to_period_hint.candidates")
        ),
    )
    of_range = on("period_change_chart") & ranged[0]
    return q.select(
        *ids,
        *keys,
        F.when(intent.isin(list(CHARTS)), intent).otherwise("unsupported").alias("intent"),
        ok.alias("found"),
        "reason",
        chart_type.alias("chart_type"),
        F.when(on("numeric_summary_chart"), F.col("c.column"))
        .when(on("trend_chart") | on("period_change_chart"), trend_column())
        .alias("column"),
        F.when(on("numeric_summary_chart"), metric).alias("metric"),
        F.when(of_range, F.col("at_from_period_hint.period")).alias("from_period"),
        F.when(of_range, F.col("at_to_period_hint.period")).alias("to_period"),
        F.coalesce(points, F.array().cast(POINTS)).alias("points"),
        F.coalesce(candidates, no_names()).alias("candidates"),
    )


def comparison_charts(comparisons: DataFrame, ids: Sequence[str] = ("request_id",)) -> DataFrame:
    """Value comparisons as two labelled bars; see `plans.comparison.compare_datasets`."""
    bars = F.array(
        *[
            F.struct(
                file_label(side, f"File {side.upper()}").alias("x"),
                F.col(value).alias("y"),
                F.lit(None).cast("string").alias("direction"),
            )
            for side, value in (("a", "previous_num"), ("b", "current_num"))
        ]
    )
    supported = F.coalesce(F.col("comparison_type") == "file_value_comparison", F.lit(False))
    ok = supported & F.col("found")
    return comparisons.select(
        *ids,
        F.lit("file_comparison_chart").alias("intent"),
        ok.alias("found"),
        F.when(~supported, "unsupported_comparison").otherwise(F.col("reason")).alias("reason"),
        F.when(ok, "numeric_summary").alias("chart_type"),
        F.when(ok, F.col("column")).alias("column"),
        F.when(ok, F.col("metric")).alias("metric"),
        F.when(ok, bars).otherwise(F.array().cast(POINTS)).alias("points"),
        "extra.candidates",
    )
