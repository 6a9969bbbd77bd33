"""Answers to tables of structured questions, looked up and never invented."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import ASKED, computed_once, once_each, stored
from sumwise.functions.text import double_text
from sumwise.operators.intents import validate_intents
from sumwise.operators.series import year_totals
from sumwise.plans.analysis import Analysis
from sumwise.plans.grounding import (
    attach,
    column_reason,
    ground,
    missed,
    no_names,
    no_series,
    period_reason,
    trend_column,
    trend_reason,
    year_of,
)

# What may be asked for.
INTENTS = [
    "period_value",
    "period_extremum",
    "period_change",
    "column_stat",
    "anomaly_check",
    "missing_values",
    "unsupported",
]
QUESTION = ["intent", "metric", "column_hint", "period_hint", "from_period_hint", "to_period_hint"]
STAT_METRICS = ["sum", "mean", "median", "min", "max", "count"]

# The sentence for every failure.
FAILURES = {
    "column_not_found": "I couldn't find a column matching that question.",
    "ambiguous_column": "That column reference is ambiguous.",
    "period_not_found": "I couldn't find a period matching that question.",
    "ambiguous_period": "That period reference is ambiguous.",
    "trend_not_computed": "No trend has been computed for this dataset yet, so that question can't be answered.",
    "profile_not_computed": "No data profile has been computed for this dataset yet, so that question can't be answered.",
    "column_series_mismatch": "That column doesn't match the currently selected trend series.",
    "unsupported": "That question isn't supported yet.",
    "invalid_json": "The question couldn't be interpreted (the AI response wasn't valid JSON).",
    "invalid_schema": "The question couldn't be interpreted (the AI response didn't match the expected format).",
    "provider_error": "The question couldn't be interpreted because the AI provider returned an error.",
    "file_not_found": "I couldn't find a file matching that reference.",
    "insufficient_files": "At least two distinct files are needed for a comparison.",
    "role_not_assigned": "No file has been assigned that role yet.",
    "duplicate_role": "That reference matches more than one file — please be more specific.",
    "column_not_found_in_file_a": "I couldn't find that column in the first file.",
    "column_not_found_in_file_b": "I couldn't find that column in the second file.",
    "ambiguous_column_in_file_a": "That column reference is ambiguous in the first file.",
    "ambiguous_column_in_file_b": "That column reference is ambiguous in the second file.",
    "period_not_found_in_file_a": "I couldn't find that period in the first file.",
    "period_not_found_in_file_b": "I couldn't find that period in the second file.",
    "ambiguous_period_in_file_a": "That period reference is ambiguous in the first file.",
    "ambiguous_period_in_file_b": "That period reference is ambiguous in the second file.",
    "trend_not_computed_in_file_a": "No trend has been computed for the first file yet, so that comparison can't be answered.",
    "trend_not_computed_in_file_b": "No trend has been computed for the second file yet, so that comparison can't be answered.",
    "unsupported_comparison": "That comparison isn't supported yet.",
}
UNKNOWN_FAILURE = "That question couldn't be answered."


def answer_questions(
    intents: DataFrame,
    analysis: Analysis,
    ids: Sequence[str] = ("request_id",),
    then: Callable[[DataFrame], DataFrame] = lambda results: results,
) -> DataFrame:
    """One grounded result per intent: `found, reason, intent, column, period, value, extra`.

    `intents` has `ids`, the keys of the analysis, `intent, metric, column_hint,
    period_hint, from_period_hint, to_period_hint`.  Every different question of a dataset is
    answered once, however many intents repeat it; `then` (such as `with_answers`) adds
    columns to these answers, row by row, before the intents get them.
    """
    fields = [*analysis.keys, *QUESTION]
    return once_each(intents, ids, fields, lambda asked: then(_answered(asked, analysis, [ASKED])))


def _answered(intents: DataFrame, analysis: Analysis, ids: Sequence[str]) -> DataFrame:
    """All intents share one plan: lookups keyed by dataset and hint are joined to the requests, then one rule per intent picks."""
    keys = list(analysis.keys)
    own = {k: k for k in keys}
    q = ground(intents, analysis, ["period_hint", "from_period_hint", "to_period_hint"])
    totals = year_totals(analysis.series, keys).select(*keys, "year", "value")
    q = attach(q, totals, {**own, "year": year_of("period_hint")}, "y")
    q = attach(
        q,
        analysis.changes.drop("column"),
        {**own, "from_period": "at_from_period_hint.period", "to_period": "at_to_period_hint.period"},
        "d",
    )

    intent, metric = F.col("intent"), F.col("metric")
    untrended = F.when(no_series(), "trend_not_computed")
    stat = F.coalesce(metric.isin(STAT_METRICS), F.lit(False))
    extremum = F.coalesce(metric.isin("min", "max"), F.lit(False))
    by_year = year_of("period_hint").isNotNull()
    year_reason = F.coalesce(
        untrended,
        F.when(missed("y"), "period_not_found"),
        F.when(metric != "sum", "unsupported"),
        trend_reason(),
    )
    reason = (
        F.when(
            intent == "period_value", F.coalesce(untrended, trend_reason(), period_reason("period_hint"))
        )
        .when(
            intent == "period_extremum",
            F.coalesce(F.when(~extremum, "unsupported"), untrended, trend_reason()),
        )
        .when(
            intent == "period_change",
            F.coalesce(
                untrended,
                trend_reason(),
                period_reason("from_period_hint"),
                period_reason("to_period_hint"),
                F.when(missed("d"), "period_not_found"),
            ),
        )
        .when(
            intent == "column_stat",
            F.when(~stat, "unsupported").when(by_year, year_reason).otherwise(column_reason()),
        )
        .when(intent == "anomaly_check", F.coalesce(untrended, trend_reason()))
        .when(intent == "missing_values", F.when(missed("f"), "profile_not_computed"))
        .otherwise("unsupported")
    )
    q = computed_once(q, q.columns, reason=reason)
    found = F.col("reason").isNull()

    def on(*names: str) -> Column:
        return found & intent.isin(*names)

    by_metric = F.coalesce(*[F.when(metric == m, F.col(f"c.stats.{m}").cast("double")) for m in STAT_METRICS])
    best = F.when(metric == "min", F.col("f.series.lowest")).when(metric == "max", F.col("f.series.highest"))
    value = (
        F.when(on("period_value"), F.col("at_period_hint.value"))
        .when(on("period_extremum"), best["value"])
        .when(on("period_change"), F.col("d.absolute_change"))
        .when(on("column_stat") & by_year, F.col("y.value"))
        .when(on("column_stat"), by_metric)
        .when(on("anomaly_check"), F.col("f.anomalies.anomaly_count").cast("double"))
        .when(on("missing_values"), F.col("f.missing.value").cast("double"))
    )
    column = F.when(on("column_stat") & ~by_year, F.col("c.column")).when(
        on("period_value", "period_extremum", "period_change", "column_stat", "anomaly_check"),
        trend_column(),
    )
    period = F.when(on("period_value"), F.col("at_period_hint.period")).when(
        on("period_extremum"), best["period"]
    )
    candidates = F.when(F.col("reason") == "ambiguous_column", F.col("c.candidates")).when(
        F.col("reason") == "ambiguous_period",
        F.when(intent == "period_value", F.col("at_period_hint.candidates"))
        .when(F.col("at_from_period_hint.reason").isNotNull(), F.col("at_from_period_hint.candidates"))
        .otherwise(F.col("at_to_period_hint.candidates")),
    )
    no_pair = (
        (intent == "period_change")
        & (F.col("reason") == "period_not_found")
        & F.col("at_from_period_hint.period").isNotNull()
        & F.col("at_to_period_hint.period").isNotNull()
    )
    with_metric = on("period_extremum", "column_stat") | (
        (intent == "column_stat") & stat & by_year & (F.col("reason") == "unsupported")
    )
    changed, checked = on("period_change"), on("anomaly_check")
    extra = F.struct(
        F.coalesce(candidates, no_names()).alias("candidates"),
        F.when(with_metric, metric).alias("metric"),
        F.when(changed | no_pair, F.col("at_from_period_hint.period")).alias("from_period"),
        F.when(changed | no_pair, F.col("at_to_period_hint.period")).alias("to_period"),
        *[
            F.when(changed, F.col(f"d.{c}")).alias(c)
            for c in ("previous", "current", "absolute_change", "percentage_change", "is_valid")
        ],
        *[
            F.when(checked, F.col(f"f.anomalies.{c}")).alias(c)
            for c in ("insufficient_data", "lower_bound", "upper_bound", "anomalies")
        ],
        F.when(on("missing_values"), F.col("f.missing.columns")).alias("columns"),
    )
    return computed_once(
        q,
        [*ids, *keys],
        intent=F.when(intent.isin(INTENTS), intent).otherwise("unsupported"),
        found=found,
        reason=F.col("reason"),
        column=column,
        period=period,
        value=value,
        extra=extra,
    )


def shown(c: Column | str) -> Column:
    """A number as an answer shows it; a missing one is `None`."""
    return F.coalesce(double_text(c), F.lit("None"))


def shown_count(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("bigint").cast("string"), F.lit("None"))


def named(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("None"))


def failure_text(reason: Column, candidates: Column) -> Column:
    """The sentence for a failure, with the candidates where there are any."""
    sentences = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    listed = F.when(
        F.size(candidates) > 0, F.concat(F.lit(" Candidates: "), F.array_join(candidates, ", "), F.lit("."))
    )
    return F.concat(
        F.coalesce(F.try_element_at(sentences, reason), F.lit(UNKNOWN_FAILURE)), F.coalesce(listed, F.lit(""))
    )


def missing_sentence(columns: Column) -> Column:
    parts = F.transform(
        columns, lambda c: F.concat(c["name"], F.lit(" ("), c["missing_count"].cast("string"), F.lit(" missing)"))
    )
    return F.when(
        F.size(columns) > 0,
        F.concat(F.lit("Columns with missing values: "), F.array_join(parts, ", "), F.lit(".")),
    ).otherwise("No columns have missing values.")


def counted_anomalies(count: Column, suffix: Column) -> Column:
    return F.when(count == 0, F.concat(F.lit("No anomalies were detected"), suffix, F.lit("."))).otherwise(
        F.concat(
            shown_count(count),
            F.when(count == 1, " anomaly").otherwise(" anomalies"),
            F.lit(" detected"),
            suffix,
            F.lit("."),
        )
    )


def with_answers(results: DataFrame) -> DataFrame:
    """Grounded results with the answer as a sentence; every number comes from the result."""
    intent, extra = F.col("intent"), F.col("extra")
    column, period = named("column"), named("period")
    metric = extra["metric"]
    numbers = {"__value": F.when(metric == "count", shown_count("value")).otherwise(shown("value"))} | {
        f"__{c}": shown(extra[c]) for c in ("previous", "current", "absolute_change", "percentage_change")
    }
    value = F.col("__value")
    extreme = F.when(metric == "min", "lowest").when(metric == "max", "highest").otherwise("extreme")
    suffix = F.coalesce(F.concat(F.lit(" for "), F.col("column")), F.lit(""))
    sentences = {
        "period_value": F.concat(column, F.lit(" in "), period, F.lit(" was "), value, F.lit(".")),
        "period_extremum": F.concat(
            F.lit("The "), extreme, F.lit(" value of "), column, F.lit(" was "), value,
            F.lit(", in "), period, F.lit("."),
        ),
        "period_change": F.concat(
            column, F.lit(" changed from "), F.col("__previous"), F.lit(" in "), named(extra["from_period"]),
            F.lit(" to "), F.col("__current"), F.lit(" in "), named(extra["to_period"]),
            F.lit(", a change of "), F.col("__absolute_change"),
            F.when(
                extra["percentage_change"].isNotNull(),
                F.concat(F.lit(" ("), F.col("__percentage_change"), F.lit("%)")),
            ).otherwise(""),
            F.lit("."),
        ),
        "column_stat": F.concat(
            F.lit("The "), F.coalesce(metric, F.lit("value")), F.lit(" of "), column, F.lit(" is "), value, F.lit("."),
        ),
        "anomaly_check": F.when(
            F.coalesce(extra["insufficient_data"], F.lit(False)),
            F.concat(F.lit("There is not enough data"), suffix, F.lit(" to reliably check for anomalies.")),
        ).otherwise(counted_anomalies(F.col("value"), suffix)),
        "missing_values": missing_sentence(extra["columns"]),
    }
    text = F.coalesce(*[F.when(intent == name, s) for name, s in sentences.items()], F.lit(UNKNOWN_FAILURE))
    answer = F.when(F.col("found"), text).otherwise(failure_text(F.col("reason"), extra["candidates"]))
    return results.withColumns(numbers).select(*results.columns, answer.alias("answer"))


def answer_responses(
    responses: DataFrame, analysis: Analysis, ids: Sequence[str] = ("request_id",), response: str = "response"
) -> DataFrame:
    """From the text a model wrote about a question to the answer, in one plan.

    `responses` has `ids`, the keys of the analysis, the response and, if there is one, a
    `provider_error`.  A response that is no valid intent still gets a row and its sentence.
    Equal responses about a dataset are read and answered once.
    """
    keys, said = list(analysis.keys), _said(responses, response)

    def made(asked: DataFrame) -> DataFrame:
        read = stored(validate_intents(asked, "question", response))
        answered = _answered(read.where("is_valid").drop("is_valid", "reason"), analysis, [ASKED])
        failed = read.where(~F.col("is_valid")).select(ASKED, *keys, F.lit(False).alias("found"), "reason")
        return with_answers(answered.unionByName(failed, allowMissingColumns=True))

    return once_each(responses, ids, [*keys, *said], made)


def _said(responses: DataFrame, response: str) -> list[str]:
    return [c for c in (response, "provider_error") if c in responses.columns]
