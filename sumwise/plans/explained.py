"""Answers with the evidence behind them and the audit of what was written about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import ASKED, join_on, once_each
from sumwise.operators.audit import audit_cited
from sumwise.operators.evidence import answer_facts, comparison_facts, with_evidence_text

ROW = "__result"


def _explained(
    facts: DataFrame, columns: Sequence[str], explanations: DataFrame, ids: Sequence[str], question: str | None
) -> DataFrame:
    """`facts` holds `ids`, the whole result as a struct, and its evidence, row by row."""
    found = F.col("evidence_id").isNotNull()
    own = [c for c in facts.columns if c not in [*ids, ROW]]
    json = F.when(found, F.to_json(F.struct(*own)))
    told = with_evidence_text(facts).select(
        *ids,
        ROW,
        "evidence_id",
        F.when(found, F.col("evidence_text")).alias("evidence_text"),
        json.alias("evidence_json"),
        F.when(found, F.concat(F.lit("["), json, F.lit("]"))).alias("__payload_json"),
        F.when(found, F.array("evidence_id")).alias("__ids"),
    )
    asked = F.col(question) if question else F.lit(None).cast("string")
    written = explanations.select(
        *ids, F.col("response").alias("__response"), asked.alias("__question"), F.lit(True).alias("__written")
    )
    pairs = join_on(told, written, ids)
    audited_by = ["__response", "__payload_json", "__ids", "__question"]
    explanation = F.struct("is_valid", "reason", "insight", "evidence_ids_used").alias("__audit")

    def audited(different: DataFrame) -> DataFrame:
        return audit_cited(different, *audited_by).select(ASKED, explanation)

    # Equal texts about equal evidence are audited once.
    kept = [ROW, "evidence_id", "evidence_text", "evidence_json", "__payload_json", "__written"]
    return once_each(pairs, kept, audited_by, audited).select(
        *[F.col(f"{ROW}.{c}") for c in columns],
        "evidence_id",
        "evidence_text",
        "evidence_json",
        F.when(found & F.col("__written"), F.col("__audit")).alias("explanation"),
    )


def explain_answers(
    answers: DataFrame,
    explanations: DataFrame,
    ids: Sequence[str] = ("request_id",),
    file_label: str | None = None,
    question: str | None = None,
) -> DataFrame:
    """`answers` with `evidence_id, evidence_text, evidence_json` and the `explanation`.

    `answers` comes from `with_answers(answer_questions(...))`, `explanations` has `ids`
    and the written `response`; `question` names its column with the question, whose
    labels (such as `Plan_2024`) may be used too.  The answer stands whatever becomes of the explanation; a result that
    was not found has neither evidence nor explanation.
    """
    rows = answers.withColumn(ROW, F.struct(*answers.columns))
    facts = answer_facts(rows, [*ids, ROW], file_label)
    return _explained(facts, answers.columns, explanations, ids, question)


def explain_comparisons(
    comparisons: DataFrame, explanations: DataFrame, ids: Sequence[str] = ("request_id",), question: str | None = None
) -> DataFrame:
    """As `explain_answers`, for `with_comparison_answers(compare_datasets(...))`."""
    rows = comparisons.withColumn(ROW, F.struct(*comparisons.columns))
    return _explained(comparison_facts(rows, [*ids, ROW]), comparisons.columns, explanations, ids, question)
