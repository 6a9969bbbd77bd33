"""What a column means: role, semantic type, unit; and checked proposals to refine it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import join_on
from sumwise.functions.text import CURRENCY_CODES
from sumwise.operators.profile import column_facts, inferred_type
from sumwise.operators.samples import cell_text, first_values, row_order

# The closed vocabularies, and the limits of the rules.
ROLES = ["dimension", "measure", "date", "identifier", "unknown"]
SEMANTIC_TYPES = ["numeric", "currency", "percentage", "date", "text", "identifier", "unknown"]
TIME_ROLES = ["period", "timestamp", "none"]
MAX_SAMPLES = 3
DOMINANT_SHARE = 0.5
UNIQUE_SHARE = 0.98
CERTAIN, LIKELY, UNKNOWN = 0.9, 0.65, 0.3
STRONG = 0.85


def _meaning(role: str, semantic_type: str, confidence: float, time_role="none", unit=None) -> Column:
    return F.struct(
        F.lit(role).alias("role"),
        F.lit(semantic_type).alias("semantic_type"),
        (unit if unit is not None else F.lit(None)).cast("string").alias("unit"),
        (F.lit(time_role) if isinstance(time_role, str) else time_role).alias("time_role"),
        F.lit(confidence).alias("confidence"),
    )


def currency_unit(name: Column, samples: Column) -> Column:
    """Code of the first known symbol found in the name or the samples."""
    text = F.concat_ws("\n", name, samples)
    units = [F.when(text.contains(symbol), code) for symbol, code in CURRENCY_CODES.items()]
    return F.coalesce(*units)


def column_schema(
    df: DataFrame, keys: Sequence[str] = (), order_by: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Role, semantic type, unit, time role, confidence and evidence of every column.

    `order_by` says which values are the first ones; without it the order of the files does.  A
    table without either has no samples, and a currency unit comes from the column name alone.
    """
    keys = list(keys)
    facts = column_facts(df, keys, columns)
    order = row_order(df, order_by)
    if order:
        names = [c for c in df.columns if c not in keys]
        texts = [
            F.struct(F.lit(i).alias("position"), cell_text(df, c).alias("text"))
            for i, c in enumerate(names)
            if columns is None or c in columns
        ]
        cells = df.select(*keys, *[c.alias(o) for o, c in order.items()], F.inline(F.array(*texts)))
        samples = first_values(cells.where(F.col("text").isNotNull()), keys, list(order), MAX_SAMPLES, ["text"])
        facts = join_on(facts, samples.withColumnRenamed("values", "__samples"), [*keys, "position"])
        facts = facts.withColumn(
            "sample_values", F.coalesce("__samples", F.array().cast("array<string>"))
        )
    else:
        facts = facts.withColumn("sample_values", F.array().cast("array<string>"))

    rows = F.col("row_count")
    present = F.greatest(rows - F.col("missing_count"), F.lit(1))
    inferred = inferred_type()
    meaning = (
        F.when(
            inferred == "date-like",
            _meaning("date", "date", CERTAIN, F.when(F.col("has_time"), "timestamp").otherwise("period")),
        )
        .when(inferred == "numeric", _meaning("measure", "numeric", CERTAIN))
        .when(
            F.col("currency_count") / present >= DOMINANT_SHARE,
            _meaning("measure", "currency", LIKELY, unit=currency_unit(F.col("name"), F.col("sample_values"))),
        )
        .when(
            F.col("percentage_count") / present >= DOMINANT_SHARE,
            _meaning("measure", "percentage", LIKELY, unit=F.lit("%")),
        )
        .when(
            (rows > 1) & (F.col("unique_count") / F.greatest(rows, F.lit(1)) >= UNIQUE_SHARE),
            _meaning("identifier", "identifier", LIKELY),
        )
        .when(rows == 0, _meaning("unknown", "unknown", UNKNOWN))
        .otherwise(_meaning("dimension", "text", LIKELY))
    )
    evidence = F.struct(F.col("name").alias("header"), "sample_values", "dtype")
    return facts.select(*keys, "position", "name", meaning.alias("m"), evidence.alias("evidence")).select(
        *keys, "position", "name", "m.*", "evidence"
    )


def candidate_metadata(schema: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The compact view of a column that a proposal may be based on."""
    return schema.select(
        *keys,
        "position",
        "name",
        "evidence.dtype",
        "evidence.sample_values",
        F.col("role").alias("candidate_role"),
        F.col("semantic_type").alias("candidate_semantic_type"),
        F.col("confidence").alias("candidate_confidence"),
    )


def merge_schema_proposals(schema: DataFrame, proposals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The schema with every acceptable proposed field taken over, and the decisions.

    `proposals` has `keys, name, role, semantic_type, unit, time_role`; a NULL field
    proposes nothing.  A value outside its vocabulary is rejected, and so is one that
    contradicts a column whose meaning is certain.
    """
    vocabulary = {"role": ROLES, "semantic_type": SEMANTIC_TYPES, "unit": None, "time_role": TIME_ROLES}
    offered = proposals.select(
        *keys, "name", F.lit(True).alias("__proposed"), *[F.col(f).alias(f"__p_{f}") for f in vocabulary]
    )
    joined = join_on(schema, offered, [*keys, "name"])
    decisions, merged = [], {}
    for f, allowed in vocabulary.items():
        p, now = F.col(f"__p_{f}"), F.col(f)
        invalid = ~p.isin(allowed) if allowed else F.lit(False)
        against = (F.col("confidence") >= STRONG) & ~p.eqNullSafe(now)
        reason = F.when(invalid, "invalid_value").when(against, "contradicts_strong_evidence")
        accepted = p.isNotNull() & reason.isNull()
        merged[f] = F.when(accepted, p).otherwise(now).alias(f)
        decisions.append(
            F.when(
                p.isNotNull(),
                F.struct(
                    F.lit(f).alias("field"),
                    accepted.alias("accepted"),
                    F.when(accepted, p).alias("value"),
                    reason.alias("reason"),
                ),
            )
        )
    log = F.when(F.col("__proposed"), F.filter(F.array(*decisions), lambda d: d.isNotNull()))
    return joined.select(*[merged.get(c, F.col(c)) for c in schema.columns], log.alias("decisions"))
