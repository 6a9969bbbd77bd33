"""Pairwise comparison of registered datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import ASKED, computed_once, join_on, once_each, stored, stored_together
from sumwise.functions.change import change
from sumwise.functions.text import strip
from sumwise.operators.intents import validate_intents
from sumwise.operators.resolve import file_lookup
from sumwise.operators.summary import STATS
from sumwise.plans.analysis import Analysis
from sumwise.plans.grounding import (
    attach,
    column_lookup,
    dataset_facts,
    given,
    missed,
    month_lookup,
    no_names,
)
from sumwise.plans.questions import UNKNOWN_FAILURE, failure_text, named, shown, shown_count
from sumwise.sources.tables import FILE_ROLES

# What two datasets can be compared by.
COMPARISONS = [
    "file_value_comparison",
    "file_period_comparison",
    "file_trend_comparison",
    "file_anomaly_comparison",
]
COMPARED = ["intent", "column_hint", "metric", "period_hint", "from_file_hint", "to_file_hint"]
SIDES = ("a", "b")
SUFFIXED = ["column_not_found", "ambiguous_column", "period_not_found", "ambiguous_period"]


def _with_datasets(requests: DataFrame, datasets: DataFrame, scope: Sequence[str]) -> DataFrame:
    """`requests` with the datasets their hints match, as `fa` and `fb`, and their number in `n`."""
    own = {k: k for k in scope}
    identity = datasets.select(F.col("dataset_id"), F.struct("dataset_id", "display_name", "role").alias("file"))
    lookup = file_lookup(datasets, scope)
    one = F.when(F.size("__ids") == 1, F.col("__ids")[0])
    lookup = join_on(lookup.withColumn("dataset_id", one), identity, ["dataset_id"])
    known, counts = stored_together(lookup, datasets.groupBy(*scope).agg(F.count(F.lit(1)).alias("files")))
    out = attach(requests, counts, own, "n")
    for side, hint in zip(SIDES, ("from_file_hint", "to_file_hint"), strict=True):
        word = F.lower(strip(hint))
        kind = F.when(word.isin(FILE_ROLES), "role").otherwise("name")
        out = attach(out, known, {**own, "__kind": kind, "__hint": F.when(word != "", word)}, f"f{side}")
    return out


def _file_reason(side: str, hint: str) -> Column:
    ids = F.col(f"f{side}.__ids")
    return (
        F.when(F.size(ids) > 1, "duplicate_role")
        .when(F.size(ids) == 1, None)
        .when(F.lower(strip(hint)).isin(FILE_ROLES), "role_not_assigned")
        .otherwise("file_not_found")
    )


def _in_file(reason: Column, side: str) -> Column:
    return F.when(reason.isin(SUFFIXED), F.concat(reason, F.lit(f"_in_file_{side}"))).otherwise(reason)


def compare_datasets(
    requests: DataFrame,
    datasets: DataFrame,
    analysis: Analysis,
    ids: Sequence[str] = ("request_id",),
    scope: Sequence[str] = (),
    then: Callable[[DataFrame], DataFrame] = lambda results: results,
) -> DataFrame:
    """One comparison per request between exactly two datasets.

    `requests` has `ids`, `scope`, `intent, column_hint, metric, period_hint,
    from_file_hint, to_file_hint`; the first dataset is the previous one.  `scope`
    separates registries of datasets.  `analysis` is keyed by `dataset_id`.  Every different
    comparison of a scope is made once, however many requests repeat it; `then` (such as
    `with_comparison_answers`) adds columns to it, row by row, before the requests get it.
    """
    if list(analysis.keys) != ["dataset_id"]:
        raise ValueError("the analysis must be keyed by dataset_id")
    return once_each(requests, ids, [*scope, *COMPARED], lambda asked: then(_compared(asked, datasets, analysis, [ASKED], scope)))


def _compared(requests: DataFrame, datasets: DataFrame, analysis: Analysis, ids: Sequence[str], scope: Sequence[str]) -> DataFrame:
    q = _with_datasets(requests, datasets, scope)
    pair = F.array(F.col("fa.dataset_id"), F.col("fb.dataset_id"))
    asked = q.select(F.explode(pair).alias("dataset_id"), "column_hint", "period_hint").where(
        F.col("dataset_id").isNotNull()
    )
    facts, columns, months = stored_together(
        dataset_facts(analysis), column_lookup(asked, analysis), month_lookup(asked, analysis, ["period_hint"])
    )
    for s in SIDES:
        own = {"dataset_id": f"f{s}.dataset_id"}
        q = attach(q, facts, own, f"d{s}")
        q = attach(q, columns, {**own, "__hint": strip("column_hint")}, f"c{s}")
        q = attach(q, months, {**own, "__hint": strip("period_hint")}, f"p{s}")

    kind = F.col("intent")
    file_reason = F.coalesce(
        F.when(~F.coalesce(kind.isin(COMPARISONS), F.lit(False)), "unsupported_comparison"),
        F.when(F.coalesce(F.col("n.files"), F.lit(0)) < 2, "insufficient_files"),
        _file_reason("a", "from_file_hint"),
        _file_reason("b", "to_file_hint"),
        F.when(F.col("fa.dataset_id") == F.col("fb.dataset_id"), "insufficient_files"),
    )

    def value_reason(s: str) -> Column:
        own = F.when(missed(f"c{s}"), "column_not_found").otherwise(F.col(f"c{s}.reason"))
        return _in_file(own, s)

    def trend_reason(s: str) -> Column:
        plain = F.when(missed(f"c{s}"), "column_not_found").otherwise(F.col(f"c{s}.reason"))
        mismatch = F.when(F.col(f"c{s}.column") != F.col(f"d{s}.series.column"), "column_series_mismatch")
        return F.when(given("column_hint"), F.coalesce(_in_file(plain, s), mismatch))

    def period_reason(s: str) -> Column:
        own = F.when(missed(f"p{s}"), "period_not_found").otherwise(F.col(f"p{s}.reason"))
        return _in_file(own, s)

    no_trend = F.coalesce(*[F.when(F.col(f"d{s}.series").isNull(), f"trend_not_computed_in_file_{s}") for s in SIDES])
    on_series = F.coalesce(no_trend, trend_reason("a"), trend_reason("b"))
    reason = F.coalesce(
        file_reason,
        F.when(kind == "file_value_comparison", F.coalesce(value_reason("a"), value_reason("b"))).when(
            kind == "file_period_comparison",
            F.coalesce(on_series, period_reason("a"), period_reason("b")),
        ).otherwise(on_series),
    )

    def side_value(s: str) -> Column:
        by_metric = [F.when(F.col("metric") == m, F.col(f"c{s}.stats.{m}").cast("double")) for m in STATS]
        return (
            F.when(kind == "file_value_comparison", F.coalesce(*by_metric))
            .when(kind == "file_period_comparison", F.col(f"p{s}.value"))
            .when(kind == "file_anomaly_comparison", F.col(f"d{s}.anomalies.anomaly_count").cast("double"))
        )

    q = computed_once(
        q, q.columns, __reason=reason, __files=file_reason, __previous=side_value("a"), __current=side_value("b")
    ).withColumn("__change", change("__previous", "__current"))
    ok = F.col("__reason").isNull()
    on_trend = ok & (kind == "file_trend_comparison")
    numeric = ok & (kind != "file_trend_comparison")
    on_value = F.coalesce(kind == "file_value_comparison", F.lit(False)) & F.col("__files").isNull()

    def series_column(s: str) -> Column:
        return F.when(given("column_hint"), F.col(f"c{s}.column")).otherwise(F.col(f"d{s}.series.column"))

    def identity(s: str) -> Column:
        return F.when(
            F.col("__files").isNull(),
            F.col(f"f{s}.file"),
        )

    def candidates() -> Column:
        r = F.col("__reason")
        options = [F.when(r.endswith(f"column_in_file_{s}"), F.col(f"c{s}.candidates")) for s in SIDES]
        options += [F.when(r.endswith(f"period_in_file_{s}"), F.col(f"p{s}.candidates")) for s in SIDES]
        # The first side whose hint matches several files is the one that failed.
        options += [F.when((r == "duplicate_role") & (F.size(f"f{s}.__ids") > 1), F.col(f"f{s}.__ids")) for s in SIDES]
        return F.coalesce(F.when(~ok, F.coalesce(*options)), no_names())

    column = F.when(kind == "file_value_comparison", F.col("ca.column")).otherwise(series_column("a"))
    extra = F.struct(
        candidates().alias("candidates"),
        F.when(numeric, F.col("__change.reason")).alias("compare_reason"),
        F.when(ok & on_value & (F.col("ca.column") != F.col("cb.column")), F.col("cb.column")).alias("column_file_b"),
        F.when(
            ok & (kind == "file_period_comparison") & (F.col("pa.period") != F.col("pb.period")), F.col("pb.period")
        ).alias("period_file_b"),
        *[F.when(on_trend, F.col(f"d{s}.trend")).alias(f"file_{s}_trend") for s in SIDES],
        *[
            F.when(ok & (kind == "file_anomaly_comparison"), F.col(f"d{s}.anomalies")).alias(f"file_{s}_anomalies")
            for s in SIDES
        ],
    )
    return computed_once(
        q,
        [*ids, *scope],
        found=ok,
        reason=F.col("__reason"),
        comparison_type=kind,
        metric=F.when(on_value, F.col("metric")),
        column=F.when(ok, column),
        period=F.when(ok & (kind == "file_period_comparison"), F.col("pa.period")),
        file_a=identity("a"),
        file_b=identity("b"),
        previous_num=F.when(numeric, F.col("__change.previous")),
        current_num=F.when(numeric, F.col("__change.current")),
        previous_label=F.when(on_trend, F.col("da.trend.trend")),
        current_label=F.when(on_trend, F.col("db.trend.trend")),
        absolute_change=F.when(numeric, F.col("__change.absolute_change")),
        percentage_change=F.when(numeric, F.col("__change.percentage_change")),
        is_valid=F.when(on_trend, True).when(numeric, F.col("__change.is_valid")),
        extra=extra,
    )


def public_identity(comparisons: DataFrame) -> DataFrame:
    """The results without internal dataset ids: a file is its display name and role."""
    return comparisons.withColumns({f: F.col(f).dropFields("dataset_id") for f in ("file_a", "file_b")})


def file_label(side: str, otherwise: str = "the file") -> Column:
    f = F.col(f"file_{side}")
    names = [F.when(f[c] != "", f[c]) for c in ("display_name", "role")]
    return F.coalesce(*names, F.lit(otherwise))


def with_comparison_answers(comparisons: DataFrame) -> DataFrame:
    """Comparisons with the answer as a sentence; every number comes from the result."""
    kind, metric = F.col("comparison_type"), F.col("metric")
    a, b = file_label("a"), file_label("b")
    whole = F.coalesce(metric.isin("count", "missing_count"), kind == "file_anomaly_comparison", F.lit(False))
    numbers = {
        f"__{c}": F.when(whole, shown_count(c)).otherwise(shown(c))
        for c in ("previous_num", "current_num", "absolute_change")
    } | {"__pct": shown("percentage_change")}
    previous, current, moved = F.col("__previous_num"), F.col("__current_num"), F.col("__absolute_change")
    has_change, has_pct = F.col("absolute_change").isNotNull(), F.col("percentage_change").isNotNull()
    by = F.when(has_pct, F.concat(F.lit(" ("), F.col("__pct"), F.lit("%)"))).otherwise("")
    changed = F.when(has_change, F.concat(F.lit(", a change of "), moved, by))
    uncomputed = F.when(F.col("extra.compare_reason").isNotNull(), " (no change could be computed)").otherwise("")
    many = F.when(F.col("previous_num") == 1, " anomaly").otherwise(" anomalies")
    sentences = {
        "file_value_comparison": F.concat(
            F.lit("The "), F.coalesce(metric, F.lit("value")), F.lit(" of "), named("column"), F.lit(" for "), b,
            F.lit(" is "), current, F.lit(", compared with "), previous, F.lit(" for "), a,
            F.coalesce(changed, uncomputed), F.lit("."),
        ),
        "file_period_comparison": F.concat(
            named("column"), F.lit(" in "), named("period"), F.lit(" for "), b, F.lit(" is "), current,
            F.lit(", compared with "), previous, F.lit(" for "), a, F.coalesce(changed, F.lit("")), F.lit("."),
        ),
        "file_trend_comparison": F.concat(
            a, F.lit("'s trend is "), named("previous_label"), F.lit(", while "), b, F.lit("'s trend is "),
            named("current_label"), F.lit("."),
        ),
        "file_anomaly_comparison": F.concat(
            a, F.lit(" has "), previous, many, F.lit(", "), b, F.lit(" has "), current,
            F.when(has_change, F.concat(F.lit(" — a change of "), moved)).otherwise(""), F.lit("."),
        ),
    }
    text = F.coalesce(*[F.when(kind == name, s) for name, s in sentences.items()], F.lit(UNKNOWN_FAILURE))
    answer = F.when(F.col("found"), text).otherwise(failure_text(F.col("reason"), F.col("extra.candidates")))
    return comparisons.withColumns(numbers).select(*comparisons.columns, answer.alias("answer"))


def compare_responses(
    responses: DataFrame,
    datasets: DataFrame,
    analysis: Analysis,
    ids: Sequence[str] = ("request_id",),
    scope: Sequence[str] = (),
    response: str = "response",
) -> DataFrame:
    """As `questions.answer_responses`, for comparisons between two datasets."""
    said = [c for c in (response, "provider_error") if c in responses.columns]

    def made(asked: DataFrame) -> DataFrame:
        read = stored(validate_intents(asked, "comparison", response))
        compared = _compared(read.where("is_valid").drop("is_valid", "reason"), datasets, analysis, [ASKED], scope)
        failed = read.where(~F.col("is_valid")).select(ASKED, *scope, F.lit(False).alias("found"), "reason")
        return with_comparison_answers(compared.unionByName(failed, allowMissingColumns=True))

    return once_each(responses, ids, [*scope, *said], made)
