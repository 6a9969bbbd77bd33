"""Evaluation of benchmark cases by the operators they exercise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import bound, by_keys, computed_once, stored
from sumwise.functions.jsontext import parsed_json
from sumwise.operators.audit import audit_insights
from sumwise.operators.evidence import claims_cause
from sumwise.operators.intents import VOCABULARIES, validate_intents
from sumwise.operators.resolve import (
    resolve_column,
    resolve_own_column,
    resolve_own_period,
    resolve_own_semantic_column,
    resolve_period,
    resolve_semantic_column,
)

# The categories, and the safety checks that go to the question schema.
CATEGORIES = [
    "column_resolution",
    "period_resolution",
    "semantic_resolution",
    "intent_classification",
    "chart_intent_classification",
    "grounding",
    "safety",
]
LOOKUPS = CATEGORIES[:3]
RESPONSE_CHECKS = ["unsupported_question", "malformed_response", "provider_failure"]

CASE = ["case_id", "category", "expected"]
BY_CASE = ["case_id"]


def _input(field: str) -> Column:
    return F.get_json_object("input", f"$.{field}")


def _names(field: str) -> Column:
    return F.from_json(_input(field), "array<string>")


def _as_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("actual")


def _columns(cases: DataFrame, field: str, name: Column) -> DataFrame:
    """`case_id, position, name` of the columns a case lists."""
    listed = cases.select("case_id", F.posexplode(name).alias("position", "name"))
    return listed.where(F.col("name").isNotNull())


def _schema_names() -> Column:
    return F.from_json(_input("schema_columns"), "array<struct<name: string>>")["name"]


def _found(value: str) -> Column:
    return _as_json(**{c: F.col(c) for c in ("found", "reason", value, "candidates")})


def _found_semantic() -> Column:
    scored = F.exists("candidates", lambda c: c["confidence"].isNotNull())
    plain = F.to_json(F.transform("candidates", lambda c: c["column"]))
    fields = {c: F.col(c) for c in ("found", "reason", "column", "confidence")}
    candidates = F.try_parse_json(F.when(scored, F.to_json("candidates")).otherwise(plain))
    return _as_json(**fields, candidates=candidates)


def _column_cases(cases: DataFrame) -> DataFrame:
    asked = cases.select(*CASE, _input("column_hint").alias("column_hint"))
    found = resolve_column(asked, _columns(cases, "column_names", _names("column_names")), BY_CASE, shuffled=True)
    return found.select(*CASE, _found("column"))


def _period_cases(cases: DataFrame) -> DataFrame:
    asked = cases.select(*CASE, _input("period_hint").alias("period_hint"))
    labels = cases.select("case_id", F.explode(_names("period_labels")).alias("period"))
    found = resolve_period(asked, labels, BY_CASE, shuffled=True)
    return found.select(*CASE, _found("period"))


def _semantic_cases(cases: DataFrame) -> DataFrame:
    asked = cases.select(*CASE, _input("term").alias("term"))
    found = resolve_semantic_column(asked, _columns(cases, "schema_columns", _schema_names()), BY_CASE, shuffled=True)
    return found.select(*CASE, _found_semantic())


def _lookup_cases(cases: DataFrame, hint: str, names: Column, own: Callable[[DataFrame, str], DataFrame], actual: Column, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cases of one lookup: each by itself, but cases that share an id, whose lists are one, by joins.

    Nearly all that a case needs stands in its row, so `own` moves the rows once, to see which ids repeat.
    """
    alone = F.count(F.lit(1)).over(by_keys(BY_CASE)) == 1
    counted = cases.select(*CASE, "input", alone.alias("__alone"))
    asked = counted.select(
        *CASE, "__alone", F.when(~F.col("__alone"), F.col("input")).alias("input"),
        *[F.when(F.col("__alone"), c).alias(n) for n, c in ((hint, _input(hint)), ("__names", names))],
    )
    found = own(asked, "__names").select(*CASE, "input", "__alone", F.when(F.col("__alone"), actual).alias("actual"))
    done = stored(_judged(found))
    rest = stored(_judged(joined(done.where(~F.col("__alone")).select(*CASE, "input"))))
    return done.where("__alone").select(*rest.columns).unionByName(rest)


def _kind() -> Column:
    """What is to be done with a case that needs nothing but itself."""
    category = F.col("category")
    safety = bound(
        _input("check"),
        lambda check: F.when(check.isin(RESPONSE_CHECKS), "question")
        .when(check.isin("causal_claim", "evidence_reference"), check)
        .otherwise("unknown_check"),
    )
    return (
        F.when(category == "intent_classification", "question")
        .when(category == "chart_intent_classification", "chart")
        .when(category == "grounding", "grounding")
        .when(category == "safety", safety)
        .otherwise("unknown_category")
    )


def _only(kind: str, **fields: Column) -> dict[str, Column]:
    """The fields for the cases of one kind, NULL for all others."""
    return {name: F.when(F.col("__kind") == kind, c) for name, c in fields.items()}


def _of_kind(kind: str, actual: Column) -> list[Column]:
    return [c.alias(f"__{name}") for name, c in _only(kind, **{kind: actual}).items()]


def _own_cases(cases: DataFrame) -> DataFrame:
    """Cases that need no lookup: intents, charts, grounding, safety, and unknown categories, in one pass."""
    none = F.array().cast("array<string>")
    known = F.from_json(_input("evidence_list"), "array<struct<evidence_id: string>>")["evidence_id"]
    unsupported = F.array_except(F.coalesce(_names("referenced_ids"), none), F.coalesce(known, none))
    kind = F.col("__kind")
    judged = kind.isin("question", "chart")
    # What is needed of the input is read once, as every step moves the whole row.
    done = computed_once(
        computed_once(cases, [*CASE, "input"], __kind=_kind()),
        [*CASE, "__kind"],
        __asked=F.when(judged, _input("question").isNotNull()),
        __response=F.when(judged | (kind == "grounding"), _input("llm_response")),
        __error=F.when(judged | (kind == "grounding"), _input("provider_error")),
        **_only("grounding", __payload=F.coalesce(_input("analytics_payload"), F.lit("{}"))),
        **_only("causal_claim", __causal_claim=_as_json(flagged=claims_cause(_input("text")))),
        **_only("evidence_reference", __evidence_reference=_as_json(valid=F.size(unsupported) == 0)),
    )
    kept = done.columns
    written = {"response": F.col("__response"), "provider_error": F.col("__error")}
    actual = {}
    for name in ("question", "chart"):
        checked = validate_intents(done.withColumns(_only(name, **written)), name)
        intent = F.to_json(F.struct(*VOCABULARIES[name].fields), {"ignoreNullFields": "false"})
        whole = F.when(F.col("is_valid"), F.try_parse_json(intent))
        said = _as_json(is_valid=F.col("is_valid"), reason=F.col("reason"), intent=whole)
        done = checked.select(*kept, *actual.values(), *_of_kind(name, F.when(F.col("__asked"), said)))
        actual[name] = f"__{name}"
    audited = audit_insights(done.withColumns(_only("grounding", payload=F.col("__payload"), **written)))
    fields = {c: F.col(c) for c in ("is_valid", "reason", "insight")}
    done = audited.select(*kept, *actual.values(), *_of_kind("grounding", _as_json(**fields)))
    actual["grounding"] = "__grounding"

    made = {name: F.col(c) for name, c in actual.items()} | {
        "causal_claim": F.col("__causal_claim"),
        "evidence_reference": F.col("__evidence_reference"),
        "unknown_check": _as_json(reason=F.lit("unknown_check")),
    }
    chosen = F.coalesce(*[F.when(F.col("__kind") == kind, c) for kind, c in made.items()])
    return done.select(*CASE, chosen.alias("actual"))


def matches_expected(actual: Column | str, expected: Column | str) -> Column:
    """Whether every field the expected JSON names has the same value in the actual one.

    A field that is absent counts as null; numbers are equal by value.
    """
    fields = "map<string, variant>"
    read = [F.try_variant_get(parsed_json(c), "$", fields).alias(name) for name, c in (("a", actual), ("e", expected))]

    def same(mine: Column, theirs: Column) -> Column:
        as_text = F.coalesce(F.to_json(mine), F.lit("null")) == F.coalesce(F.to_json(theirs), F.lit("null"))
        numeric = F.schema_of_variant(mine).rlike("^(BIGINT|DOUBLE|DECIMAL)") & F.schema_of_variant(
            theirs
        ).rlike("^(BIGINT|DOUBLE|DECIMAL)")
        as_number = F.try_variant_get(mine, "$", "double") == F.try_variant_get(theirs, "$", "double")
        return as_text | F.coalesce(numeric & as_number, F.lit(False))

    none = F.array().cast("array<string>")
    return bound(
        F.struct(*read),
        lambda r: F.forall(
            F.coalesce(F.map_keys(r["e"]), none),
            lambda key: same(F.try_element_at(r["a"], key), F.try_element_at(r["e"], key)),
        ),
    )


def _judged(done: DataFrame) -> DataFrame:
    """`done` with `passed`: a case of a known category with the fields it expects."""
    known = F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))
    as_expected = F.when(known & F.col("actual").isNotNull(), matches_expected("actual", "expected"))
    return computed_once(done, done.columns, passed=F.coalesce(as_expected, F.lit(False)))


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """`case_id, category, passed, actual, expected, reason` for `sources.cases.load_cases`.

    The three categories that look something up are a plan each, stored one after the other, so that the driver holds one such
    plan at a time; no side of their joins, for cases that share an id, is broadcast.  All others are one pass.  A case
    that lacks what its evaluator needs fails with `evaluator_error`, one of an unknown category with `unknown_category`.
    """
    cases = cases.select(
        "case_id", "category", F.coalesce("input", F.lit("{}")).alias("input"),
        F.coalesce("expected", F.lit("{}")).alias("expected"),
    )

    def of(category: str) -> DataFrame:
        return cases.where(F.col("category") == category)

    parts = [
        _lookup_cases(of("column_resolution"), "column_hint", _names("column_names"), resolve_own_column, _found("column"), _column_cases),
        _lookup_cases(of("period_resolution"), "period_hint", _names("period_labels"), resolve_own_period, _found("period"), _period_cases),
        _lookup_cases(of("semantic_resolution"), "term", _schema_names(), resolve_own_semantic_column, _found_semantic(), _semantic_cases),
        _judged(_own_cases(cases.where(~F.coalesce(F.col("category").isin(LOOKUPS), F.lit(False))))),
    ]
    known = F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))
    reason = (
        F.when(~known, "unknown_category")
        .when(F.col("actual").isNull(), "evaluator_error")
        .when(~F.col("passed"), "mismatch")
    )
    results = reduce(DataFrame.unionByName, parts)
    return results.select(
        "case_id",
        "category",
        "passed",
        F.coalesce("actual", F.lit("{}")).alias("actual"),
        "expected",
        reason.alias("reason"),
    )


def summarize(results: DataFrame) -> DataFrame:
    """`category, total, passed, accuracy`; the row without a category is the overall one."""
    by_category = results.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    )
    overall = by_category.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed")
    ).select(F.lit(None).cast("string").alias("category"), "total", "passed")
    stacked = overall.unionByName(by_category)
    return stacked.withColumn("accuracy", F.try_divide(F.col("passed"), F.col("total")))


def summary_lines(summary: DataFrame) -> DataFrame:
    """`category, line` of the readable summary; order by category, overall first."""
    share = F.format_string("%.1f%%", F.bround(F.col("accuracy") * 100, 1))
    counts = F.concat(F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"))
    line = F.concat(counts, F.lit(" ("), share, F.lit(")"))
    return summary.select(
        "category",
        F.when(F.col("total") == 0, "Overall: no cases run")
        .when(F.col("category").isNull(), F.concat(F.lit("Overall: "), line))
        .otherwise(F.concat(F.lit("  "), F.col("category"), F.lit(": "), line))
        .alias("line"),
    )


def failure_lines(results: DataFrame) -> DataFrame:
    """`case_id, line` for every case that did not pass; one line without an id if all did."""
    line = F.concat(
        F.col("case_id"), F.lit(" ("), F.col("category"), F.lit("): expected "), F.col("expected"),
        F.lit(", got "), F.col("actual"), F.lit(" ["), F.col("reason"), F.lit("]"),
    )
    failed = stored(results.where(~F.col("passed")).select("case_id", line.alias("line")))
    none = failed.agg(F.count("*").alias("n")).where("n = 0")
    return failed.unionByName(none.select(F.lit(None).cast("string").alias("case_id"), F.lit("No failed cases.").alias("line")))
