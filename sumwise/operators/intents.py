"""Checks that machine-written JSON keeps to its closed schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import computed_once, join_on
from sumwise.functions.jsontext import parsed_json
from sumwise.operators.schema import ROLES, SEMANTIC_TYPES, TIME_ROLES


@dataclass(frozen=True)
class Vocabulary:
    intents: tuple[str, ...]
    metrics: tuple[str, ...]
    hints: tuple[str, ...]

    @property
    def fields(self) -> list[str]:
        return ["intent", "metric", *self.hints]


# The four closed schemas.
PERIOD_HINTS = ("column_hint", "period_hint", "from_period_hint", "to_period_hint")
FILE_HINTS = ("column_hint", "period_hint", "from_file_hint", "to_file_hint")
ALL_METRICS = ("sum", "mean", "median", "min", "max", "std", "count")
VOCABULARIES = {
    "question": Vocabulary(
        (
            "period_value",
            "period_extremum",
            "period_change",
            "column_stat",
            "anomaly_check",
            "missing_values",
            "unsupported",
        ),
        ("sum", "mean", "median", "min", "max", "count"),
        PERIOD_HINTS,
    ),
    "chart": Vocabulary(
        ("trend_chart", "numeric_summary_chart", "period_change_chart", "missing_values_chart", "unsupported"),
        ALL_METRICS,
        PERIOD_HINTS,
    ),
    "comparison": Vocabulary(
        (
            "file_value_comparison",
            "file_period_comparison",
            "file_trend_comparison",
            "file_anomaly_comparison",
            "unsupported",
        ),
        ALL_METRICS,
        FILE_HINTS,
    ),
    "comparison_chart": Vocabulary(("file_comparison_chart", "unsupported"), ALL_METRICS, FILE_HINTS),
}


def json_shape(parsed: Column) -> Column:
    """The type of a parsed JSON value as text, with object keys in alphabetical order."""
    return F.schema_of_variant(parsed)


def shape_pattern(required: dict[str, str]) -> str:
    """The pattern of an object with exactly these keys, each of the given types."""
    return "^OBJECT<" + ", ".join(f"{k}: {required[k]}" for k in sorted(required)) + ">$"


TEXT = "STRING"
TEXT_OR_NULL = "(STRING|VOID)"


def provider_error(df: DataFrame) -> Column:
    """The `provider_error` column where there is one; empty text is no error."""
    if "provider_error" not in df.columns:
        return F.lit(None).cast("string")
    return F.when(F.col("provider_error") != "", F.col("provider_error"))


def validate_intents(responses: DataFrame, vocabulary: str | Vocabulary, response: str = "response") -> DataFrame:
    """`responses` with `is_valid, reason` and the fields of a valid intent.

    A response must be a JSON object with exactly the required keys, a known intent, a
    known metric or null, and hints that are text or null.  A `provider_error` column, if
    there is one, goes before all of that.
    """
    v = VOCABULARIES[vocabulary] if isinstance(vocabulary, str) else vocabulary
    required = {f: TEXT_OR_NULL for f in v.fields} | {"intent": TEXT}
    parsed = computed_once(responses, responses.columns, __v=parsed_json(response))

    def field(name: str) -> Column:
        return F.try_variant_get("__v", f"$.{name}", "string")

    fits = (
        json_shape(F.col("__v")).rlike(shape_pattern(required))
        & field("intent").isin(*v.intents)
        & (field("metric").isNull() | field("metric").isin(*v.metrics))
    )
    reason = F.coalesce(
        provider_error(responses),
        F.when(F.col("__v").isNull(), "invalid_json"),
        F.when(~F.coalesce(fits, F.lit(False)), "invalid_schema"),
    )
    checked = computed_once(parsed, [*responses.columns, "__v"], reason=reason)
    ok = F.col("reason").isNull()
    return checked.select(
        *responses.columns,
        ok.alias("is_valid"),
        "reason",
        *[F.when(ok, field(f)).alias(f) for f in v.fields],
    )


def validate_schema_proposals(
    responses: DataFrame, columns: DataFrame, keys: Sequence[str] = ("dataset_id",), response: str = "response"
) -> DataFrame:
    """`responses` with `is_valid, reason, proposals` for proposed column meanings.

    A response is `{"columns": [...]}` with one entry per column, all of them known by
    `columns` (`keys, name`), each at most once.  One bad entry rejects all of them.
    """
    names = columns.groupBy(*keys).agg(F.collect_set("name").alias("__known"))
    joined = join_on(computed_once(responses, responses.columns, __v=parsed_json(response)), names, keys)
    listed = F.try_variant_get("__v", "$.columns", "variant")
    entry_shape = shape_pattern(
        {"name": TEXT, "role": TEXT, "semantic_type": TEXT, "unit": TEXT_OR_NULL, "time_role": TEXT}
    )
    fields = ["name", "role", "semantic_type", "unit", "time_role"]
    joined = joined.withColumn(
        "__entries",
        F.transform(
            F.try_variant_get("__v", "$.columns", "array<variant>"),
            lambda e: F.struct(
                F.schema_of_variant(e).rlike(entry_shape).alias("fits"),
                *[F.try_variant_get(e, f"$.{f}", "string").alias(f) for f in fields],
            ),
        ),
    )
    known = F.coalesce("__known", F.array().cast("array<string>"))
    good = F.forall(
        "__entries",
        lambda e: e["fits"]
        & F.array_contains(known, e["name"])
        & e["role"].isin(ROLES)
        & e["semantic_type"].isin(SEMANTIC_TYPES)
        & e["time_role"].isin(TIME_ROLES),
    )
    proposed = F.transform("__entries", lambda e: e["name"])
    is_list = F.schema_of_variant(listed).startswith("ARRAY")
    only_columns = F.json_object_keys(response) == F.array(F.lit("columns"))
    fits = only_columns & is_list & good & (F.size(F.array_distinct(proposed)) == F.size(proposed))
    blank = F.coalesce(F.btrim(F.col(response), F.lit(" \t\n\r\x0b\x0c")) == "", F.lit(True))
    reason = F.coalesce(
        provider_error(responses),
        F.when(blank, "empty_response"),
        F.when(F.col("__v").isNull(), "invalid_json"),
        F.when(~F.coalesce(fits, F.lit(False)), "invalid_schema"),
    )
    checked = computed_once(joined, [*responses.columns, "__entries"], reason=reason)
    ok = F.col("reason").isNull()
    return checked.select(
        *responses.columns,
        ok.alias("is_valid"),
        "reason",
        F.when(ok, F.transform("__entries", lambda e: e.dropFields("fits"))).alias("proposals"),
    )


def accepted_proposals(validated: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """`keys, name, role, semantic_type, unit, time_role` of the valid responses."""
    return validated.where("is_valid").select(*keys, F.inline("proposals"))
