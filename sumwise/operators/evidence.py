"""Evidence: typed facts taken from results, and checks of what cites them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import bound, by_keys, join_on
from sumwise.functions.text import double_text

# The kinds of evidence and the phrases that claim a cause.
EVIDENCE_TYPES = [
    "period_value",
    "period_extremum",
    "period_change",
    "column_stat",
    "anomaly_summary",
    "missing_values",
    "trend",
    "file_comparison",
    "forecast",
]
CAUSAL_PHRASES = [
    "caused",
    "causes",
    "causing",
    "because of the increase",
    "because of the decrease",
    "led to",
    "leads to",
    "resulted in",
    "results in",
    "due to the increase",
    "due to the decrease",
    "driving the",
    "drove the",
    "is responsible for",
    "are responsible for",
]
SOURCE_FIELDS = ["file", "column", "period", "from_period", "to_period", "file_a", "file_b"]
NO_SUMMARY = "Supporting data is available but could not be summarized."


def evidence_id(index: Column | int) -> Column:
    return F.format_string("ev_%03d", index if isinstance(index, Column) else F.lit(index))


def _source(**fields: Column) -> Column:
    return F.struct(*[fields.get(f, F.lit(None)).cast("string").alias(f) for f in SOURCE_FIELDS])


def evidence_of_answers(
    results: DataFrame, ids: Sequence[str], file_label: Column | str | None = None, start_index: int = 1
) -> DataFrame:
    """One piece of evidence per found result of `plans.questions.answer_questions`.

    Every value is read from the result.  `file_label` names the file in the source; it
    must not be an internal id.
    """
    return answer_facts(results.where("found"), ids, file_label, start_index).where(
        F.col("evidence_id").isNotNull()
    )


def answer_facts(
    results: DataFrame, ids: Sequence[str], file_label: Column | str | None = None, start_index: int = 1
) -> DataFrame:
    """As `evidence_of_answers`, row by row: a result without evidence has no id."""
    label = F.col(file_label) if isinstance(file_label, str) else file_label
    extra, intent = F.col("extra"), F.col("intent")
    kind = F.when(intent == "anomaly_check", "anomaly_summary").otherwise(intent)

    def only(c: Column, *intents: str) -> Column:
        return F.when(intent.isin(*intents), c)

    changed = ["previous", "current", "absolute_change", "percentage_change", "is_valid"]
    return results.select(
        *ids,
        F.when(F.col("found") & (intent != "unsupported"), evidence_id(start_index)).alias("evidence_id"),
        kind.alias("type"),
        _source(
            file=F.lit(None) if label is None else label,
            column=only(F.col("column"), *[i for i in EVIDENCE_TYPES if i != "missing_values"], "anomaly_check"),
            period=F.col("period"),
            from_period=extra["from_period"],
            to_period=extra["to_period"],
        ).alias("source"),
        only(F.col("value"), "period_value", "period_extremum", "column_stat").alias("value"),
        extra["metric"].alias("metric"),
        *[extra[c].alias(c) for c in changed],
        only(F.col("value").cast("bigint"), "anomaly_check").alias("anomaly_count"),
        extra["lower_bound"].alias("lower_bound"),
        extra["upper_bound"].alias("upper_bound"),
        extra["anomalies"].alias("anomalies"),
        only(F.col("value").cast("bigint"), "missing_values").alias("column_count_with_missing"),
        extra["columns"].alias("columns"),
    )


def evidence_of_comparisons(comparisons: DataFrame, ids: Sequence[str], start_index: int = 1) -> DataFrame:
    """One piece of evidence per found result of `plans.comparison.compare_datasets`."""
    return comparison_facts(comparisons.where("found"), ids, start_index)


def comparison_facts(comparisons: DataFrame, ids: Sequence[str], start_index: int = 1) -> DataFrame:
    """As `evidence_of_comparisons`, row by row: a result without evidence has no id."""

    def label(side: str) -> Column:
        f = F.col(f"file_{side}")
        return F.coalesce(*[F.when(f[c] != "", f[c]) for c in ("display_name", "role")])

    source = _source(column=F.col("column"), period=F.col("period"), file_a=label("a"), file_b=label("b"))
    return comparisons.select(
        *ids,
        F.when(F.col("found"), evidence_id(start_index)).alias("evidence_id"),
        F.lit("file_comparison").alias("type"),
        source.alias("source"),
        "comparison_type",
        "metric",
        F.col("previous_num").alias("previous"),
        F.col("current_num").alias("current"),
        "previous_label",
        "current_label",
        "absolute_change",
        "percentage_change",
        "is_valid",
        F.col("extra.compare_reason").alias("compare_reason"),
    )


def evidence_json(evidence: DataFrame, ids: Sequence[str], name: str = "evidence_json") -> DataFrame:
    """`ids` and the evidence as a JSON object, absent fields left out."""
    facts = [c for c in evidence.columns if c not in ids]
    return evidence.select(*ids, F.to_json(F.struct(*facts)).alias(name))


def with_evidence_text(evidence: DataFrame) -> DataFrame:
    """`evidence` with its sentence as `evidence_text`; a field it lacks reads as missing.

    Numbers may be numeric columns or ready text.
    """
    types = dict(evidence.dtypes)
    has = set(evidence.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in has else F.lit(None)

    def shown(name: str) -> Column:
        if name not in has:
            return F.lit("None")
        return F.coalesce(double_text(name) if types[name] == "double" else F.col(name).cast("string"), F.lit("None"))

    numbers = ["value", "previous", "current", "absolute_change", "percentage_change", "forecast", "anomaly_count"]
    staged = evidence.withColumns({f"__{n}": shown(n) for n in numbers})
    text = {n: F.col(f"__{n}") for n in numbers}
    for side in ("previous", "current"):
        if f"{side}_label" in has:
            text[side] = F.coalesce(F.col(f"{side}_label"), text[side])

    def source(name: str, otherwise: str = "None") -> Column:
        return F.coalesce(F.when(F.col(f"source.{name}") != "", F.col(f"source.{name}")), F.lit(otherwise))

    metric = field("metric").cast("string")
    extreme = F.when(metric == "min", "lowest").when(metric == "max", "highest").otherwise("extreme")
    moved, pct = field("absolute_change").isNotNull(), field("percentage_change").isNotNull()
    by = F.when(pct, F.concat(F.lit(" ("), text["percentage_change"], F.lit("%)"))).otherwise("")
    change = F.concat(F.lit(", a change of "), text["absolute_change"])
    count = field("anomaly_count").cast("bigint")
    suffix = F.coalesce(F.concat(F.lit(" for "), F.col("source.column")), F.lit(""))
    missing = F.lit("No columns have missing values.")
    if "columns" in has:
        parts = F.transform(
            "columns", lambda c: F.concat(c["name"], F.lit(" ("), c["missing_count"].cast("string"), F.lit(" missing)"))
        )
        listed = F.concat(F.lit("Columns with missing values: "), F.array_join(parts, ", "), F.lit("."))
        missing = F.when(F.size("columns") > 0, listed).otherwise(missing)
    value = F.when(metric == "count", F.regexp_replace(text["value"], r"\.0$", "")).otherwise(text["value"])
    sentences = {
        "period_value": F.concat(
            source("column"), F.lit(" in "), source("period"), F.lit(" was "), text["value"], F.lit("."),
        ),
        "period_extremum": F.concat(
            F.lit("The "), extreme, F.lit(" value of "), source("column"), F.lit(" was "), text["value"],
            F.lit(", in "), source("period"), F.lit("."),
        ),
        "period_change": F.concat(
            source("column"), F.lit(" changed from "), text["previous"], F.lit(" in "), source("from_period"),
            F.lit(" to "), text["current"], F.lit(" in "), source("to_period"),
            F.when(moved, F.concat(change, by)).otherwise(""), F.lit("."),
        ),
        "column_stat": F.concat(
            F.lit("The "), F.coalesce(metric, F.lit("value")), F.lit(" of "), source("column"), F.lit(" is "),
            value, F.lit("."),
        ),
        "anomaly_summary": F.when(
            count == 0, F.concat(F.lit("No anomalies were detected"), suffix, F.lit("."))
        ).otherwise(
            F.concat(
                text["anomaly_count"], F.when(count == 1, " anomaly").otherwise(" anomalies"), F.lit(" detected"),
                suffix, F.lit("."),
            )
        ),
        "missing_values": missing,
        "trend": F.concat(
            source("column"), F.lit("'s trend is "), F.coalesce(field("trend").cast("string"), F.lit("None")), F.lit("."),
        ),
        "file_comparison": F.concat(
            source("column"), F.lit(" for "), source("file_b", "the second file"), F.lit(" is "), text["current"],
            F.lit(", compared with "), text["previous"], F.lit(" for "), source("file_a", "the first file"),
            F.when(moved, change).otherwise(""), F.lit("."),
        ),
        "forecast": F.concat(
            F.lit("The baseline forecast for "), source("column"), F.lit(" in "), source("period"), F.lit(" is "),
            text["forecast"], F.lit(" (method: "), F.coalesce(field("method").cast("string"), F.lit("None")),
            F.lit(") — a prediction, not a historical fact."),
        ),
    }
    sentence = F.coalesce(*[F.when(F.col("type") == t, s) for t, s in sentences.items()], F.lit(NO_SUMMARY))
    return staged.select(*evidence.columns, sentence.alias("evidence_text"))


def validate_evidence(items: DataFrame, keys: Sequence[str], json: str = "evidence_json", position: str = "position") -> DataFrame:
    """Per list of evidence: `valid, reason, evidence_id` of the first item that fails.

    `items` has `keys`, the place of an item in its list and the item as JSON text.  An
    id is a duplicate from its second place on.  Repeats are found by comparing each
    place with the first one of that id, which combines before the shuffle.
    """
    keys = list(keys)
    own_id = F.get_json_object(json, "$.evidence_id")
    named = F.array_contains(F.json_object_keys(json), "evidence_id")
    checked = items.select(
        *keys,
        F.col(position).alias("__at"),
        F.coalesce(named, F.lit(False)).alias("__named"),
        own_id.alias("__id"),
        F.get_json_object(json, "$.type").alias("__type"),
        F.col(json).rlike(r'"file_id"\s*:').alias("__leaks"),
    )
    firsts = checked.where("__named").groupBy(*keys, "__id").agg(F.min("__at").alias("__first"))
    joined = join_on(checked, firsts, [*keys, "__id"])
    reason = (
        F.when(~F.col("__named"), "malformed_evidence")
        .when(F.col("__at") > F.col("__first"), "duplicate_evidence_id")
        .when(~F.coalesce(F.col("__type").isin(EVIDENCE_TYPES), F.lit(False)), "unknown_evidence_type")
        .when(F.col("__leaks"), "file_id_leaked")
    )
    failing = F.when(
        reason.isNotNull(),
        F.struct(
            F.col("__at").alias("at"),
            reason.alias("reason"),
            F.when(F.col("__named"), F.col("__id")).alias("evidence_id"),
        ),
    )
    return joined.groupBy(*keys).agg(F.min(failing).alias("f")).select(
        *keys, F.col("f").isNull().alias("valid"), "f.reason", "f.evidence_id"
    )


def evidence_references(
    citations: DataFrame, evidence: DataFrame, keys: Sequence[str], cited: str = "evidence_ids_used"
) -> DataFrame:
    """`keys, valid, unsupported_ids` for lists of cited ids against the evidence that exists.

    `citations` has one row per `keys`.  Unsupported ids keep their place in the list.
    """
    keys = list(keys)
    each = citations.select(*keys, F.posexplode_outer(cited).alias("__at", "evidence_id"))
    known = evidence.select(*keys, "evidence_id").distinct()
    hit = join_on(each, known.withColumn("__hit", F.lit(True)), [*keys, "evidence_id"])
    bad = F.when(F.col("__hit").isNull() & F.col("__at").isNotNull(), F.struct("__at", "evidence_id"))
    return (
        hit.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(bad)).alias("__bad"))
        .select(
            *keys,
            (F.size("__bad") == 0).alias("valid"),
            F.transform("__bad", lambda b: b["evidence_id"]).alias("unsupported_ids"),
        )
    )


def claims_cause(text: Column | str) -> Column:
    """Whether a text holds one of the causal phrases, anywhere and in any case.

    No letter beyond ASCII becomes part of a phrase in lower case: `K` (Kelvin) is `k`, which none has, and
    `İ` is `i` with a dot, which ends none.
    """
    c = F.col(text) if isinstance(text, str) else text
    held = bound(F.lower(c), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in CAUSAL_PHRASES]))
    return F.coalesce(held, F.lit(False))


def numbered_evidence(evidence: DataFrame, keys: Sequence[str], order: Sequence[str], start_index: int = 1) -> DataFrame:
    """`evidence` with ids that count up within `keys`, for lists of one response each."""
    index = F.row_number().over(by_keys(keys, *order)) + F.lit(start_index - 1)
    return evidence.withColumn("evidence_id", evidence_id(index))
