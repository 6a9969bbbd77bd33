"""Audits of machine-written insights against the facts they were given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import computed_once, join_on
from sumwise.functions.jsontext import json_labels, json_numbers, parsed_json, text_numbers, unsupported_numbers
from sumwise.operators.evidence import claims_cause
from sumwise.operators.intents import provider_error

# The parts of an insight.
PROSE_LISTS = ["key_insights", "warnings", "recommendations"]
INSIGHT_KEYS = ["summary", "key_insights", "trend_interpretation", "warnings", "recommendations"]
CITED = "evidence_ids_used"


def payload_facts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """`payloads` with the `numbers` and `labels` that prose may cite."""
    return payloads.withColumns({"numbers": json_numbers(payload), "labels": json_labels(payload)})


def cited_numbers(texts: DataFrame, text: str = "text", labels: str | None = None) -> DataFrame:
    """`texts` with the `numbers` the prose cites."""
    return texts.withColumn("numbers", text_numbers(text, F.col(labels) if labels else None))


def _read(df: DataFrame, response: str) -> DataFrame:
    """The parsed response, its keys and its prose, as `__v`, `__keys`, `__prose`."""
    parsed = computed_once(df, df.columns, __v=parsed_json(response))
    parsed = parsed.withColumn("__keys", F.when(F.col("__v").isNotNull(), F.json_object_keys(response)))
    parts = [
        F.array(F.try_variant_get("__v", "$.summary", "string")),
        F.array(F.try_variant_get("__v", "$.trend_interpretation", "string")),
        *[F.try_variant_get("__v", f"$.{f}", "array<string>") for f in PROSE_LISTS],
    ]
    empty = F.array().cast("array<string>")
    prose = F.array_join(F.concat(*[F.coalesce(p, empty) for p in parts]), "\n")
    return parsed.withColumn("__prose", prose)


def _type_of(field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("__v", f"$.{field}", "variant"))


def _has_insight_shape() -> Column:
    lists = [_type_of(f).startswith("ARRAY") for f in PROSE_LISTS]
    fits = (
        (F.size(F.array_except(F.array(*[F.lit(k) for k in INSIGHT_KEYS]), F.col("__keys"))) == 0)
        & (_type_of("summary") == "STRING")
        & _type_of("trend_interpretation").isin("STRING", "VOID")
    )
    for one in lists:
        fits = fits & one
    return fits


def _invented(payload: str) -> Column:
    cited = text_numbers("__prose", json_labels(payload))
    return F.size(unsupported_numbers(cited, json_numbers(payload))) > 0


def _blank(response: str) -> Column:
    return F.coalesce(F.btrim(F.col(response), F.lit(" \t\n\r\x0b\x0c")) == "", F.lit(True))


def _insight(ok: Column, fields: Sequence[str]) -> Column:
    return F.when(
        ok,
        F.struct(
            *[
                F.try_variant_get("__v", f"$.{f}", "array<string>" if f in [*PROSE_LISTS, CITED] else "string").alias(f)
                for f in fields
            ]
        ),
    ).alias("insight")


def audit_insights(pairs: DataFrame, response: str = "response", payload: str = "payload") -> DataFrame:
    """`pairs` with `is_valid, reason, insight` for a response about a payload.

    A response needs the five parts of an insight, and every number in its prose must be
    backed by a number of the payload.  The first failure is the reason.
    """
    read = _read(pairs, response)
    reason = F.coalesce(
        provider_error(pairs),
        F.when(_blank(response), "empty_response"),
        F.when(~F.coalesce(_has_insight_shape(), F.lit(False)), "malformed_output"),
        F.when(_invented(payload), "hallucinated_numeric_value"),
    )
    checked = computed_once(read, [*pairs.columns, "__v"], reason=reason)
    ok = F.col("reason").isNull()
    return checked.select(*pairs.columns, ok.alias("is_valid"), "reason", _insight(ok, INSIGHT_KEYS))


def evidence_payload(evidence: DataFrame, keys: Sequence[str], json: str = "evidence_json", order: str | None = None) -> DataFrame:
    """`keys, payload, known_ids`: the evidence of one response as a JSON list, and its ids."""
    item = F.struct((F.col(order) if order else F.get_json_object(json, "$.evidence_id")).alias("o"), F.col(json).alias("j"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["j"])
    return evidence.groupBy(*keys).agg(
        F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("payload"),
        F.collect_set(F.get_json_object(json, "$.evidence_id")).alias("known_ids"),
    )


def audit_evidence_responses(
    responses: DataFrame,
    evidence: DataFrame,
    keys: Sequence[str],
    response: str = "response",
    question: str | None = None,
    json: str = "evidence_json",
) -> DataFrame:
    """`responses` with `is_valid, reason, insight, evidence_ids_used`.

    As `audit_insights`, with exactly six parts; besides invented numbers it rejects ids
    that are not among the evidence of the response, and claims of a cause.
    """
    facts = evidence_payload(evidence, keys, json)
    joined = join_on(
        responses, facts.select(*keys, F.col("payload").alias("__facts"), F.col("known_ids").alias("__known")), keys
    )
    return audit_cited(joined, response, "__facts", "__known", question).drop("__facts", "__known")


def audit_cited(
    pairs: DataFrame, response: str, payload: str, known_ids: str, question: str | None = None
) -> DataFrame:
    """As `audit_evidence_responses`, where each row brings its evidence.

    `payload` is a JSON list, `known_ids` the ids in it; NULL means no evidence.
    """
    listed = F.coalesce(payload, F.lit("[]"))
    if question:
        listed = F.concat(listed, F.lit(","), F.to_json(F.struct(F.col(question))))
    read = _read(pairs.withColumn("__payload", listed), response)
    exact = F.array_sort("__keys") == F.array(*[F.lit(k) for k in sorted([*INSIGHT_KEYS, CITED])])
    cited = F.try_variant_get("__v", f"$.{CITED}", "array<string>")
    all_text = _type_of(CITED).isin("ARRAY<STRING>", "ARRAY<VOID>") | (
        F.size(F.try_variant_get("__v", f"$.{CITED}", "array<variant>")) == 0
    )
    all_text = all_text & F.forall(cited, lambda i: i.isNotNull())
    no_ids = F.array().cast("array<string>")
    unknown = F.size(F.array_except(cited, F.coalesce(known_ids, no_ids))) > 0
    reason = F.coalesce(
        provider_error(pairs),
        F.when(_blank(response), "empty_response"),
        F.when(~F.coalesce(_has_insight_shape() & exact & all_text, F.lit(False)), "malformed_output"),
        F.when(_invented("__payload"), "hallucinated_numeric_value"),
        F.when(unknown, "unsupported_evidence"),
        F.when(claims_cause("__prose"), "unsupported_causal_claim"),
    )
    checked = computed_once(read, [*pairs.columns, "__v"], reason=reason)
    ok = F.col("reason").isNull()
    return checked.select(
        *pairs.columns,
        ok.alias("is_valid"),
        "reason",
        _insight(ok, INSIGHT_KEYS),
        F.when(ok, cited).alias(CITED),
    )
