"""Machine-written JSON and prose, and benchmark cases, derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import new_folder, spread
from sumwise.operators import audit, evidence, intents
from sumwise.plans import benchmark
from sumwise.sources.cases import load_cases
from workload.inputs import pick, table

PHRASES = [
    "caused", "causes", "causing", "because of the increase", "because of the decrease", "led to", "leads to",
    "resulted in", "results in", "due to the increase", "due to the decrease", "driving the", "drove the",
    "is responsible for", "are responsible for",
]


def text(*parts):
    """Concatenation of texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _spread_table(spark, folder, name):
    """The table dealt evenly: what is made of a row and judged costs far more than its bytes tell."""
    return spread(table(spark, folder, name))


def _intent_responses(spark, folder, vocabulary, read=table):
    """One response per event: right, or wrong in one of seven ways."""
    v = intents.VOCABULARIES[vocabulary]
    e = read(spark, folder, "events")
    first, k = v.intents[0], F.col("event_id")
    hints = [f'"{h}": null' for h in v.hints[1:]]

    def response(intent=f'"{first}"', metric='"sum"', hint=None, tail=""):
        own = text('"', F.col("event_type"), '"') if hint is None else F.lit(hint)
        return text(f'{{"intent": {intent}, "metric": {metric}, "column_hint": ', own, f", {', '.join(hints)}{tail}}}")

    body = pick(
        k % 8, response(), response(metric="null", hint="null"), response(intent='"guess"'), response(metric='"mode"'),
        response(hint="5"), text('{"intent": "', F.col("event_type"), '"}'), text("no json ", F.col("event_type")),
        response(tail=', "value": 1'),
    )
    error = F.when(k % 50 == 0, "provider_error")
    return e.select("event_id", body.alias("response"), error.alias("provider_error"))


def _validated(spark, folder, vocabulary):
    df = intents.validate_intents(_intent_responses(spark, folder, vocabulary), vocabulary)
    return df.select("event_id", "is_valid", "reason", "intent", "metric", "column_hint")


def q_validate_question_intents(spark, folder):
    return _validated(spark, folder, "question")


def q_validate_chart_intents(spark, folder):
    return _validated(spark, folder, "chart")


def q_validate_comparison_intents(spark, folder):
    return _validated(spark, folder, "comparison")


def q_validate_comparison_chart_intents(spark, folder):
    return _validated(spark, folder, "comparison_chart")


def _entry(name, role="measure", unit="null", semantic="text"):
    return (
        f'{{"name": "{name}", "role": "{role}", "semantic_type": "{semantic}", "unit": {unit}, "time_role": "none"}}'
    )


PROPOSALS = [
    f'{{"columns": [{_entry("revenue")}, {_entry("region", "dimension")}]}}',
    f'{{"columns": [{_entry("revenue", unit=chr(34) + "USD" + chr(34), semantic="currency")}]}}',
    f'{{"columns": [{_entry("revenue")}, {_entry("revenue", "date")}]}}',
    f'{{"columns": [{_entry("profit")}]}}',
    f'{{"columns": [{_entry("revenue", "target")}]}}',
    f'{{"columns": [{_entry("revenue", unit="7")}]}}',
    '{"columns": {}}',
    '{"columns": [], "note": "x"}',
    '{"columns": [{"name": "revenue"}]}',
    "[]",
    "none",
    " ",
]


def _schema_responses(spark, folder):
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    return c.select(k, F.col("c_nationkey").alias("dataset_id"), pick(k % 12, *[F.lit(p) for p in PROPOSALS]).alias("response"))


def _checked_proposals(spark, folder):
    desks = table(spark, folder, "nation").select(F.col("n_nationkey").alias("dataset_id"))
    columns = desks.select("dataset_id", F.explode(F.array(*[F.lit(c) for c in ("revenue", "region", "day")])).alias("name"))
    return intents.validate_schema_proposals(_schema_responses(spark, folder), columns)


def q_validate_schema_proposals(spark, folder):
    df = _checked_proposals(spark, folder)
    return df.select("c_custkey", "is_valid", "reason", F.coalesce(F.size("proposals"), F.lit(0)).alias("n"))


def q_accepted_proposals(spark, folder):
    df = intents.accepted_proposals(_checked_proposals(spark, folder))
    return df.groupBy("dataset_id", "name", "role", "unit").agg(F.count(F.lit(1)).alias("n"))


def _prose(spark, folder):
    """Whole documents, each followed by a sentence that may claim a cause."""
    d = table(spark, folder, "documents")
    k = F.col("doc_id")
    claims = [F.lit(" This rose.")] + [F.lit(f" It {p.upper() if i % 2 else p} it.") for i, p in enumerate(PHRASES)]
    return d.select(k, F.concat("text", pick(k % 16, *claims)).alias("text"))


def q_claims_cause(spark, folder):
    return _prose(spark, folder).select("doc_id", evidence.claims_cause("text").alias("flagged"))


def q_cited_numbers(spark, folder):
    """The numbers in whole documents, each with a period, an amount and a label added."""
    d = table(spark, folder, "documents")
    k = F.col("doc_id")
    full = text(F.col("text"), " In 2024-03 Plan_77 of ", k, " cost 1,234,567.5 and ", k + 1000, ".25, 3 of 2024-01-05T10:11:12.")
    labels = F.array(F.lit("Plan_77"))
    df = audit.cited_numbers(d.select(k, full.alias("text"), labels.alias("labels")), "text", "labels")
    return df.select(
        k, F.size("numbers").alias("n"), F.array_min("numbers").alias("least"), F.array_max("numbers").alias("most")
    )


def _payloads(spark, folder, read=table):
    """A nested payload per event around its own JSON properties."""
    e = read(spark, folder, "events")
    k = F.col("event_id")
    return e.select(
        k,
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        text(
            '{"name": "Plan_', k, '", "props": ', F.col("props"), ', "nested": {"value": ', F.col("value"),
            ', "flags": [true, false, null, 3, "2024-01", "a \\"', k, '\\" b"]}, "total": ', k + 1000, "}",
        ).alias("payload"),
    )


def q_payload_facts(spark, folder):
    df = audit.payload_facts(_payloads(spark, folder))
    return df.select(
        "event_id",
        F.size("numbers").alias("n"),
        F.array_max("numbers").alias("most"),
        F.array_join(F.array_sort("labels"), ";").alias("labels"),
    )


def _insight_text(summary, lists='["fine"]', more=""):
    return text(
        '{"summary": "', summary, f'", "key_insights": {lists}, "trend_interpretation": null, "warnings": [], '
        f'"recommendations": []{more}}}',
    )


def _insights(spark, folder, read=table):
    p = _payloads(spark, folder, read)
    k = F.col("event_id")
    response = pick(
        k % 9,
        _insight_text(text("The total is ", k + 1000, " for Plan_", k, " in 2024-01.")),
        _insight_text(text("The total is ", k + 2000, ".")),
        _insight_text(text("Value ", F.col("value"), ", 3 flags.")),
        _insight_text(text("Value ", F.floor("value") + 7000000, ".5 and no more.")),
        _insight_text(F.lit("ok"), lists='["see 98765432"]'),
        _insight_text(F.lit("ok"), lists='"see"'),
        text('{"summary": "', k, '"}'),
        F.lit("{"),
        F.lit(""),
    )
    error = F.when(k % 100 == 99, "provider_unavailable")
    return p.select(k, "payload", response.alias("response"), error.alias("provider_error"))


def q_audit_insights(spark, folder):
    df = audit.audit_insights(_insights(spark, folder))
    return df.select("event_id", "is_valid", "reason", F.col("insight.summary").alias("summary"))


def _user_evidence(spark, folder):
    """For every user the sum of each event type as evidence."""
    e = table(spark, folder, "events").where(F.col("value").isNotNull())
    facts = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    item = text('{"evidence_id": "ev_', F.col("event_type"), '", "type": "column_stat", "value": ', F.col("top"), ', "n": ', F.col("n"), "}")
    return facts.select("user_id", F.concat(F.lit("ev_"), "event_type").alias("evidence_id"), item.alias("evidence_json"), "top")


def _evidence_responses(spark, folder):
    e = table(spark, folder, "events")
    users = e.groupBy("user_id").agg(F.max("value").alias("top"))
    k = F.col("user_id")

    def response(summary, ids, more=""):
        return _insight_text(summary, more=f', "evidence_ids_used": {ids}{more}')

    top = text("The top is ", F.col("top"), ".")
    body = pick(
        k % 7, response(top, "[]"), response(top, '["ev_view", "ev_click", "ev_signup", "ev_error", "ev_purchase"]'),
        response(top, '["ev_none"]'), response(text("It led to ", F.col("top"), "."), "[]"),
        response(text("About ", k + 5000000, "."), "[]"), response(top, "[1]"), response(top, "[]", ', "x": 1'),
    )
    return users.select(k, body.alias("response"))


def q_audit_evidence_responses(spark, folder):
    df = audit.audit_evidence_responses(_evidence_responses(spark, folder), _user_evidence(spark, folder), ["user_id"])
    return df.select("user_id", "is_valid", "reason", F.size(F.coalesce("evidence_ids_used", F.array())).alias("cited"))


def q_evidence_references(spark, folder):
    users = table(spark, folder, "events").select("user_id").distinct()
    cited = F.array(*[F.lit(f"ev_{t}") for t in ("view", "none", "purchase", "click")])
    asked = users.select("user_id", cited.alias("evidence_ids_used"))
    df = evidence.evidence_references(asked, _user_evidence(spark, folder), ["user_id"])
    return df.withColumn("unsupported_ids", F.array_join("unsupported_ids", ";"))


def _cases(spark, folder) -> DataFrame:
    """Cases of every category from orders, parts, events and documents; some expect wrongly."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    periods = o.select(
        text("p", k).alias("case_id"),
        F.lit("period_resolution").alias("category"),
        text(
            '{"period_hint": "', F.date_format("o_orderdate", "MMMM yyyy"), '", "period_labels": ["1995-01", "',
            F.date_format("o_orderdate", "yyyy-MM"), '"]}',
        ).alias("input"),
        F.when(k % 10 == 0, '{"found": false}')
        .otherwise(text('{"found": true, "period": "', F.date_format("o_orderdate", "yyyy-MM"), '"}'))
        .alias("expected"),
    )
    p, q = table(spark, folder, "part"), F.col("p_partkey")
    columns = p.select(
        text("c", q).alias("case_id"),
        F.lit("column_resolution").alias("category"),
        text('{"column_hint": "', F.upper("p_name"), '", "column_names": ["', F.col("p_name"), '", "zzzzzz"]}').alias("input"),
        F.when(q % 10 == 0, '{"found": true, "column": "zzzzzz"}')
        .otherwise(text('{"found": true, "reason": null, "column": "', F.col("p_name"), '"}'))
        .alias("expected"),
    )
    semantic = p.select(
        text("s", q).alias("case_id"),
        F.lit("semantic_resolution").alias("category"),
        text('{"term": "total sales", "schema_columns": [{"name": "Sales Amount"}, {"name": "', F.col("p_name"), '"}]}').alias("input"),
        F.when(q % 10 == 0, '{"confidence": 0.5}').otherwise('{"found": true, "column": "Sales Amount", "confidence": 1}').alias("expected"),
    )
    e = _insights(spark, folder, _spread_table).withColumn("id", F.col("event_id"))
    quoted = F.to_json(F.struct(F.col("response").alias("llm_response"), F.col("provider_error")))
    inner = F.expr("substr({0}, 2)".replace("{0}", "__quoted"))
    grounding = e.withColumn("__quoted", quoted).select(
        text("g", F.col("id")).alias("case_id"),
        F.lit("grounding").alias("category"),
        text('{"analytics_payload": ', F.col("payload"), ", ", inner).alias("input"),
        F.when(F.col("id") % 9 == 0, '{"is_valid": true}').otherwise('{"is_valid": false}').alias("expected"),
    )
    r = _intent_responses(spark, folder, "question", _spread_table)
    asked = r.withColumn("__quoted", F.to_json(F.struct(F.col("response").alias("llm_response"), F.col("provider_error"))))
    intent = asked.select(
        text("i", F.col("event_id")).alias("case_id"),
        F.when(F.col("event_id") % 3 == 0, "intent_classification")
        .when(F.col("event_id") % 3 == 1, "chart_intent_classification")
        .otherwise("guessing")
        .alias("category"),
        text('{"question": "q", ', inner).alias("input"),
        F.lit('{"is_valid": true}').alias("expected"),
    )
    safety = _prose(spark, folder).select(
        text("d", F.col("doc_id")).alias("case_id"),
        F.lit("safety").alias("category"),
        F.to_json(F.struct(F.lit("causal_claim").alias("check"), F.col("text"))).alias("input"),
        F.lit('{"flagged": true}').alias("expected"),
    )
    return reduce(DataFrame.unionByName, [periods, columns, semantic, grounding, intent, safety])


def q_evaluate_cases(spark, folder):
    return benchmark.evaluate_cases(_cases(spark, folder)).select("case_id", "category", "passed", "reason")


def q_summarize(spark, folder):
    df = benchmark.summarize(benchmark.evaluate_cases(_cases(spark, folder)))
    return df.withColumn("accuracy", F.round("accuracy", 6))


def q_summary_lines(spark, folder):
    return benchmark.summary_lines(benchmark.summarize(benchmark.evaluate_cases(_cases(spark, folder))))


def q_failure_lines(spark, folder):
    return benchmark.failure_lines(benchmark.evaluate_cases(_cases(spark, folder)))


def q_load_cases(spark, folder):
    """Cases written as files of JSON arrays, 500 a file, and read again; every third has no metadata."""
    e = table(spark, folder, "events").select(
        text("e", F.col("event_id")).alias("case_id"),
        F.concat(F.lit("kind_"), "event_type").alias("category"),
        F.struct(F.col("value").alias("seen"), F.array("event_id", "user_id").alias("ids")).alias("input"),
        F.struct((F.col("event_id") % 2 == 0).alias("found")).alias("expected"),
        F.when(F.col("event_id") % 3 > 0, F.struct("user_id")).alias("metadata"),
        F.floor(F.col("event_id") / 500).alias("part"),
    )
    fields = ["case_id", "category", "input", "expected", "metadata"]
    arrays = e.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*fields))), ","), F.lit("]")).alias("value"))
    path = new_folder(spark)
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    df = load_cases(spark, path)
    return df.select("case_id", "category", F.get_json_object("input", "$.ids[1]").alias("user"), "expected", "metadata")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}


def _intents_sql(vocabulary: str) -> str:
    """The same responses, read by the JSON functions of the other engine."""
    v = intents.VOCABULARIES[vocabulary]
    hints = ", ".join(f'"{h}": null' for h in v.hints[1:])

    def response(intent=f'"{v.intents[0]}"', metric='"sum"', hint="' || '\"' || event_type || '\"' || '", tail=""):
        return f"""'{{"intent": {intent}, "metric": {metric}, "column_hint": {hint}, {hints}{tail}}}'"""

    texts = [
        response(), response(metric="null", hint="null"), response(intent='"guess"'), response(metric='"mode"'),
        response(hint="5"), "'{\"intent\": \"' || event_type || '\"}'", "'no json ' || event_type", response(tail=', "value": 1'),
    ]
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    types = " OR ".join(f"json_type(r, '$.{h}') NOT IN ('VARCHAR', 'NULL')" for h in ["metric", *v.hints])
    keys = sorted(["intent", "metric", *v.hints])
    return f"""t AS (SELECT event_id, CASE event_id % 8 {cases} END AS raw, event_id % 50 = 0 AS failed FROM events),
j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS r FROM t),
c AS (SELECT event_id, r, CASE WHEN failed THEN 'provider_error' WHEN r IS NULL THEN 'invalid_json'
    WHEN json_type(r) <> 'OBJECT' OR list_sort(json_keys(r)) <> {keys!r} THEN 'invalid_schema'
    WHEN json_extract_string(r, '$.intent') NOT IN {tuple(v.intents)!r} THEN 'invalid_schema'
    WHEN json_extract_string(r, '$.metric') NOT IN {tuple(v.metrics)!r} THEN 'invalid_schema'
    WHEN {types} THEN 'invalid_schema' END AS reason FROM j)"""


def _validated_sql(vocabulary: str) -> str:
    fields = ", ".join(
        f"CASE WHEN reason IS NULL THEN json_extract_string(r, '$.{f}') END AS {f}" for f in ("intent", "metric", "column_hint")
    )
    return f"WITH {_intents_sql(vocabulary)} SELECT event_id, reason IS NULL AS is_valid, reason, {fields} FROM c"


_CLAIMS = " ".join(
    f"WHEN {i + 1} THEN ' It {p.upper() if i % 2 else p} it.'" for i, p in enumerate(PHRASES)
)
_PROSE_SQL = f"""prose AS (SELECT doc_id, text || CASE doc_id % 16 WHEN 0 THEN ' This rose.' {_CLAIMS} END AS text FROM documents)"""
_FLAGGED = f"regexp_matches(lower(text), '{'|'.join(PHRASES)}')"
_DATE = r"\b[0-9]{4}-[0-9]{2}(?:-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)?)?\b"
_NUMBER = r"-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+\.[0-9]+|-?[0-9]+"
_SMALL = "NOT (x = round(x) AND abs(x) < 10)"

# What an insight of the event must be judged as, from how it was made.
_AUDIT = f"""CASE WHEN event_id % 100 = 99 THEN 'provider_unavailable' ELSE CASE event_id % 9 WHEN 0 THEN NULL
    WHEN 1 THEN CASE WHEN event_id + 2000 IN (event_id + 1000, floor(value), k) THEN NULL ELSE 'hallucinated_numeric_value' END
    WHEN 2 THEN NULL WHEN 3 THEN 'hallucinated_numeric_value' WHEN 4 THEN 'hallucinated_numeric_value'
    WHEN 5 THEN 'malformed_output' WHEN 6 THEN 'malformed_output' WHEN 7 THEN 'malformed_output' ELSE 'empty_response' END END"""
_EVENTS = "evs AS (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"

_USERS = """u AS (SELECT user_id, max(value) AS top FROM events GROUP BY 1),
ids AS (SELECT user_id, list_sort(list(DISTINCT 'ev_' || event_type)) AS ids, list(DISTINCT event_type) AS types,
  count(DISTINCT event_type) AS kinds FROM events WHERE value IS NOT NULL GROUP BY 1)"""

_CASES = f"""{_intents_sql("question")}, {_PROSE_SQL}, {_EVENTS},
results AS (
  SELECT 'p' || o_orderkey AS case_id, 'period_resolution' AS category, o_orderkey % 10 <> 0 AS passed,
    CASE WHEN o_orderkey % 10 = 0 THEN '{{"found": false}}' ELSE '{{"found": true, "period": "' || strftime(o_orderdate, '%Y-%m') || '"}}' END AS expected,
    '{{"found":true,"period":"' || strftime(o_orderdate, '%Y-%m') || '","candidates":[]}}' AS actual
  FROM orders
  UNION ALL SELECT 'c' || p_partkey, 'column_resolution', p_partkey % 10 <> 0,
    CASE WHEN p_partkey % 10 = 0 THEN '{{"found": true, "column": "zzzzzz"}}' ELSE '{{"found": true, "reason": null, "column": "' || p_name || '"}}' END,
    '{{"found":true,"column":"' || p_name || '","candidates":[]}}' FROM part
  UNION ALL SELECT 's' || p_partkey, 'semantic_resolution', p_partkey % 10 <> 0,
    CASE WHEN p_partkey % 10 = 0 THEN '{{"confidence": 0.5}}' ELSE '{{"found": true, "column": "Sales Amount", "confidence": 1}}' END,
    '{{"found":true,"column":"Sales Amount","confidence":1.0,"candidates":[]}}' FROM part
  UNION ALL SELECT 'g' || event_id, 'grounding', (judged IS NULL) = (event_id % 9 = 0),
    CASE WHEN event_id % 9 = 0 THEN '{{"is_valid": true}}' ELSE '{{"is_valid": false}}' END,
    CASE WHEN judged IS NOT NULL THEN '{{"is_valid":false,"reason":"' || judged || '"}}' ELSE '{{"is_valid":true,"insight":{{"summary":"' ||
      CASE event_id % 9 WHEN 1 THEN 'The total is ' || (event_id + 2000) || '.' ELSE 'Value ' || value || ', 3 flags.' END ||
      '","key_insights":["fine"],"warnings":[],"recommendations":[]}}}}' END
  FROM (SELECT *, {_AUDIT} AS judged FROM evs)
  UNION ALL SELECT 'i' || event_id, CASE event_id % 3 WHEN 0 THEN 'intent_classification' WHEN 1 THEN 'chart_intent_classification' ELSE 'guessing' END,
    event_id % 3 = 0 AND reason IS NULL, '{{"is_valid": true}}', CASE WHEN event_id % 3 = 2 THEN '{{}}' ELSE '{{"is_valid":false,"reason":"' ||
      CASE WHEN event_id % 3 = 0 OR reason IN ('provider_error', 'invalid_json') THEN reason ELSE 'invalid_schema' END || '"}}' END FROM c
  UNION ALL SELECT 'd' || doc_id, 'safety', {_FLAGGED}, '{{"flagged": true}}', '{{"flagged":false}}' FROM prose)"""

_SUMMARY = """s AS (SELECT category, count(*) AS total, count(*) FILTER (passed) AS passed FROM results GROUP BY 1
  UNION ALL SELECT NULL, count(*), count(*) FILTER (passed) FROM results)"""

SQL = {
    "validate_question_intents": _validated_sql("question"),
    "validate_chart_intents": _validated_sql("chart"),
    "validate_comparison_intents": _validated_sql("comparison"),
    "validate_comparison_chart_intents": _validated_sql("comparison_chart"),
    "validate_schema_proposals": """SELECT c_custkey, c_custkey % 12 IN (0, 1) AS is_valid,
        CASE WHEN c_custkey % 12 IN (0, 1) THEN NULL WHEN c_custkey % 12 = 10 THEN 'invalid_json' WHEN c_custkey % 12 = 11 THEN 'empty_response'
          ELSE 'invalid_schema' END AS reason,
        CASE c_custkey % 12 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM customer""",
    "accepted_proposals": """SELECT c_nationkey AS dataset_id, 'revenue' AS name, 'measure' AS role, NULL AS unit, count(*) AS n
        FROM customer WHERE c_custkey % 12 = 0 GROUP BY 1
      UNION ALL SELECT c_nationkey, 'region', 'dimension', NULL, count(*) FROM customer WHERE c_custkey % 12 = 0 GROUP BY 1
      UNION ALL SELECT c_nationkey, 'revenue', 'measure', 'USD', count(*) FROM customer WHERE c_custkey % 12 = 1 GROUP BY 1""",
    "claims_cause": f"WITH {_PROSE_SQL} SELECT doc_id, {_FLAGGED} AS flagged FROM prose",
    "cited_numbers": rf"""WITH t AS (SELECT doc_id, replace(text || ' In 2024-03 Plan_77 of ' || doc_id || ' cost 1,234,567.5 and ' || (doc_id + 1000)
          || '.25, 3 of 2024-01-05T10:11:12.', 'Plan_77', ' ') AS text FROM documents),
        x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{_DATE}', ' ', 'g'), '{_NUMBER}')) AS s FROM t),
        n AS (SELECT DISTINCT doc_id, round(CAST(replace(s, ',', '') AS DOUBLE), 6) AS x FROM x)
      SELECT doc_id, count(*) AS n, min(x) AS least, max(x) AS most FROM n WHERE {_SMALL} GROUP BY 1""",
    "payload_facts": f"""WITH {_EVENTS}, n AS (SELECT event_id, unnest([k, value, event_id + 1000]) AS x FROM evs),
        d AS (SELECT event_id, count(DISTINCT x) AS n, max(x) AS most FROM n WHERE {_SMALL} GROUP BY 1)
      SELECT event_id, n, most, 'Plan_' || event_id || ';a "' || event_id || '" b' AS labels FROM d""",
    "audit_insights": f"""WITH {_EVENTS}, r AS (SELECT event_id, value, {_AUDIT} AS reason FROM evs)
      SELECT event_id, reason IS NULL AS is_valid, reason, CASE WHEN reason IS NULL THEN CASE event_id % 9
        WHEN 0 THEN 'The total is ' || (event_id + 1000) || ' for Plan_' || event_id || ' in 2024-01.'
        WHEN 2 THEN 'Value ' || value || ', 3 flags.' END END AS summary FROM r""",
    "audit_evidence_responses": f"""WITH {_USERS}, r AS (SELECT u.user_id, CASE u.user_id % 7 WHEN 0 THEN NULL
          WHEN 1 THEN CASE WHEN kinds < 5 THEN 'unsupported_evidence' END WHEN 2 THEN 'unsupported_evidence' WHEN 3 THEN 'unsupported_causal_claim'
          WHEN 4 THEN 'hallucinated_numeric_value' ELSE 'malformed_output' END AS reason FROM u JOIN ids ON ids.user_id = u.user_id)
      SELECT user_id, reason IS NULL AS is_valid, reason, CASE WHEN reason IS NULL AND user_id % 7 = 1 THEN 5 ELSE 0 END AS cited FROM r""",
    "evidence_references": f"""WITH {_USERS} SELECT user_id, list_contains(ids, 'ev_view') AND false AS valid,
        concat_ws(';', CASE WHEN NOT list_contains(ids, 'ev_view') THEN 'ev_view' END, 'ev_none',
          CASE WHEN NOT list_contains(ids, 'ev_purchase') THEN 'ev_purchase' END, CASE WHEN NOT list_contains(ids, 'ev_click') THEN 'ev_click' END) AS unsupported_ids
      FROM ids""",
    "evaluate_cases": f"""WITH {_CASES} SELECT case_id, category, passed,
        CASE WHEN category = 'guessing' THEN 'unknown_category' WHEN NOT passed THEN 'mismatch' END AS reason FROM results""",
    "summarize": f"WITH {_CASES}, {_SUMMARY} SELECT category, total, passed, round(passed / total, 6) AS accuracy FROM s",
    "summary_lines": f"""WITH {_CASES}, {_SUMMARY} SELECT category, CASE WHEN category IS NULL THEN 'Overall: ' ELSE '  ' || category || ': ' END
        || passed || '/' || total || ' (' || format('{{:.1f}}', round_even(passed / total * 100, 1)) || '%)' AS line FROM s""",
    "failure_lines": f"""WITH {_CASES} SELECT case_id, case_id || ' (' || category || '): expected ' || expected || ', got ' || actual || ' [' ||
        CASE WHEN category = 'guessing' THEN 'unknown_category' ELSE 'mismatch' END || ']' AS line FROM results WHERE NOT passed""",
    "load_cases": """SELECT 'e' || event_id AS case_id, 'kind_' || event_type AS category, user_id::VARCHAR AS "user",
        CASE WHEN event_id % 2 = 0 THEN '{"found":true}' ELSE '{"found":false}' END AS expected,
        CASE WHEN event_id % 3 > 0 THEN '{"user_id":' || user_id || '}' ELSE '{}' END AS metadata FROM events""",
}
