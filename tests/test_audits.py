from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sumwise.operators import audit, evidence, intents
from sumwise.plans import benchmark
from conftest import by

GOOD = {"intent": "column_stat", "metric": "sum", "column_hint": "x", "period_hint": None, "from_period_hint": None, "to_period_hint": None}


def insight(summary="fine", **more):
    parts = {"summary": summary, "key_insights": [], "trend_interpretation": None, "warnings": [], "recommendations": []}
    return json.dumps({**parts, **more})


def judged(spark, rows, vocabulary="question"):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, response string")
    return {i: r["reason"] for i, r in by(intents.validate_intents(df, vocabulary)).items()}


def test_intents(spark):
    rows = [
        json.dumps(GOOD), json.dumps({**GOOD, "metric": None}), json.dumps({**GOOD, "metric": "std"}),
        json.dumps({**GOOD, "intent": "dance"}), json.dumps({**GOOD, "column_hint": 5}), json.dumps({**GOOD, "more": 1}),
        json.dumps({k: v for k, v in GOOD.items() if k != "metric"}), "[1]", "null", "nope", "", None,
        json.dumps({**GOOD, "intent": None}), json.dumps({**GOOD, "column_hint": ["x"]}),
    ]
    bad = "invalid_schema"
    assert list(judged(spark, rows).values()) == [None, None, bad, bad, bad, bad, bad, bad, bad, "invalid_json", "invalid_json", "invalid_json", bad, bad]


@pytest.mark.parametrize("vocabulary", list(intents.VOCABULARIES))
def test_vocabularies(spark, vocabulary):
    v = intents.VOCABULARIES[vocabulary]
    empty = dict.fromkeys(v.hints)
    rows = [json.dumps({"intent": i, "metric": m, **empty}) for i in v.intents for m in (*v.metrics, None)]
    assert set(judged(spark, rows, vocabulary).values()) == {None}


def test_provider_errors_come_first(spark):
    df = spark.createDataFrame([(1, None, "timeout"), (2, json.dumps(GOOD), "")], "id int, response string, provider_error string")
    got = by(intents.validate_intents(df, "question"))
    assert got[1]["reason"] == "timeout" and got[2]["is_valid"]


def test_insights(spark):
    payload = json.dumps({"columns": [{"name": "Plan_77", "sum": 460000.0, "mean": 115000.5}], "n": 4})
    rows = {
        insight("It is 460,000 for Plan_77 in 2024-05."): None,
        insight("About 115000."): None,
        insight("3 columns"): None,
        insight("It is 460001."): "hallucinated_numeric_value",
        insight(key_insights=["up 12.5%"]): "hallucinated_numeric_value",
        insight(trend_interpretation="77 more"): "hallucinated_numeric_value",
        insight(key_insights=[{"a": 99}]): "hallucinated_numeric_value",
        insight(more=1): None,
        insight(warnings="none"): "malformed_output",
        insight(summary=None): "malformed_output",
        insight(trend_interpretation=3): "malformed_output",
        '{"summary": "x"}': "malformed_output",
        "[]": "malformed_output",
        "{": "malformed_output",
        " \n": "empty_response",
    }
    df = spark.createDataFrame([(r, payload) for r in rows], "response string, payload string")
    for r in audit.audit_insights(df).collect():
        assert r["reason"] == rows[r["response"]], r["response"]
        assert r["is_valid"] == (r["reason"] is None) == (r["insight"] is not None)


def test_evidence_responses(spark):
    facts = spark.createDataFrame(
        [(i, '{"evidence_id": "ev_001", "type": "column_stat", "value": 50.5}') for i in range(6)], "id int, evidence_json string"
    )
    rows = [
        insight("50.5", evidence_ids_used=["ev_001"]),
        insight("50.5", evidence_ids_used=["ev_002"]),
        insight("51.5", evidence_ids_used=[]),
        insight("The rise LED TO more", evidence_ids_used=[]),
        insight("ok"),
        insight("ok", evidence_ids_used=[1]),
        insight("ok", evidence_ids_used=["ev_001"]),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, response string")
    got = by(audit.audit_evidence_responses(df, facts, ["id"]))
    assert [got[i]["reason"] for i in range(7)] == [
        None, "unsupported_evidence", "hallucinated_numeric_value", "unsupported_causal_claim", "malformed_output",
        "malformed_output", "unsupported_evidence",
    ]


def test_evidence_lists(spark):
    items = [
        (1, 0, {"evidence_id": "a", "type": "trend"}), (1, 1, {"evidence_id": "b", "type": "trend"}),
        (2, 0, {"evidence_id": "a", "type": "trend"}), (2, 1, {"evidence_id": "a", "type": "wrong"}),
        (3, 0, {"evidence_id": "a", "type": "wrong"}), (3, 1, {"type": "trend"}),
        (4, 0, {"evidence_id": "a", "type": "trend", "source": {"deep": [{"file_id": 1}]}}),
        (5, 0, {"type": "trend"}),
    ]
    df = spark.createDataFrame([(k, p, json.dumps(i)) for k, p, i in items], "id int, position int, evidence_json string")
    got = by(evidence.validate_evidence(df, ["id"]))
    assert [got[i]["reason"] for i in range(1, 6)] == [
        None, "duplicate_evidence_id", "unknown_evidence_type", "file_id_leaked", "malformed_evidence",
    ]


def test_references(spark):
    cited = spark.createDataFrame([(1, ["a", "z", "y", "a"]), (2, ["a"]), (3, [])], "id int, evidence_ids_used array<string>")
    known = spark.createDataFrame([(1, "a"), (2, "a")], "id int, evidence_id string")
    got = by(evidence.evidence_references(cited, known, ["id"]))
    assert got[1]["unsupported_ids"] == ["z", "y"] and got[2]["valid"] and got[3]["valid"]


@pytest.mark.parametrize("text, flagged", [("It CAUSED it", True), ("results in", True), ("because of rain", False), ("misled together", True), (None, False)])
def test_causes(spark, text, flagged):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(evidence.claims_cause("t").alias("x")).first()["x"] is flagged


def test_numbered_evidence(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    got = evidence.numbered_evidence(df, ["k"], ["n"], start_index=999).collect()
    assert sorted(r["evidence_id"] for r in got) == ["ev_1000", "ev_999", "ev_999"]


CASES = [
    ("ok1", "column_resolution", {"column_hint": "rev", "column_names": ["Rev", "Cost"]}, {"found": True, "column": "Rev"}),
    ("ok2", "period_resolution", {"period_hint": "May", "period_labels": ["2023-05", "2024-05"]}, {"reason": "ambiguous_period", "candidates": ["2023-05", "2024-05"]}),
    ("ok3", "semantic_resolution", {"term": "units", "schema_columns": [{"name": "Units Sold"}]}, {"confidence": 0.6667}),
    ("ok4", "intent_classification", {"question": "q", "llm_response": json.dumps(GOOD)}, {"is_valid": True, "intent": GOOD}),
    ("ok5", "chart_intent_classification", {"question": "q", "llm_response": "x"}, {"reason": "invalid_json"}),
    ("ok6", "grounding", {"analytics_payload": {"a": 25}, "llm_response": insight("25")}, {"is_valid": True}),
    ("ok7", "safety", {"check": "causal_claim", "text": "a causes b"}, {"flagged": True}),
    ("ok8", "safety", {"check": "evidence_reference", "referenced_ids": ["x"], "evidence_list": [{"evidence_id": "y"}]}, {"valid": False}),
    ("ok9", "safety", {"check": "provider_failure", "question": "q", "provider_error": "down"}, {"is_valid": False, "reason": "down"}),
    ("ok10", "safety", {"check": "?"}, {"reason": "unknown_check", "other": None}),
    ("bad1", "column_resolution", {"column_hint": "rev", "column_names": []}, {"found": True}),
    ("bad2", "dancing", {}, {}),
    ("bad3", "intent_classification", {}, {}),
]


def test_benchmark(spark):
    rows = [(c, k, json.dumps(i), json.dumps(e)) for c, k, i, e in CASES]
    df = spark.createDataFrame(rows, "case_id string, category string, input string, expected string")
    results = benchmark.evaluate_cases(df)
    got = by(results, "case_id")
    assert {c for c, r in got.items() if r["passed"]} == {c for c, *_ in CASES if c.startswith("ok")}
    assert [got[f"bad{i}"]["reason"] for i in (1, 2, 3)] == ["mismatch", "unknown_category", "evaluator_error"]
    lines = [r["line"] for r in benchmark.summary_lines(benchmark.summarize(results)).orderBy("category").collect()]
    assert lines[0] == "Overall: 10/13 (76.9%)" and "  safety: 4/4 (100.0%)" in lines
    assert benchmark.failure_lines(results).count() == 3
    nothing = benchmark.summarize(results.where("false"))
    assert benchmark.summary_lines(nothing).first()["line"] == "Overall: no cases run"
    assert nothing.first()["accuracy"] is None


def test_no_case_is_broadcast(spark):
    """Sides with a row for each case would meet on the driver, however small Spark guesses them to be."""
    rows = [(c, k, json.dumps(i), json.dumps(e)) for c, k, i, e in CASES]
    df = spark.createDataFrame(rows, "case_id string, category string, input string, expected string")
    parts = [benchmark._column_cases, benchmark._period_cases, benchmark._semantic_cases]
    plans = [part(df)._jdf.queryExecution().executedPlan().toString() for part in parts]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    whole = benchmark.evaluate_cases(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in whole and whole.count("Exchange") == 0


def test_a_response_is_one_json_value(spark):
    from sumwise.functions.jsontext import parsed_json

    good = ["{}", ' {"a": 1} ', "[1, 2]", "1", '"x"', "null", "true"]
    bad = ["", " ", None, "{} thanks", "{}{}", "{}, {}", "1 2", "1] x [2", "{}} x {", "[1", "1}", "{} Hope this helps! 123456"]
    df = spark.createDataFrame([(t, t in good) for t in good + bad], "t string, ok boolean")
    assert df.where(parsed_json("t").isNotNull() != F.col("ok")).collect() == []


def test_text_after_a_valid_response_rejects_it(spark):
    from sumwise.operators.audit import audit_cited, audit_insights
    from sumwise.operators.intents import validate_intents

    said = {"summary": "fine", "key_insights": [], "trend_interpretation": None, "warnings": [], "recommendations": []}
    texts = [json.dumps(said), json.dumps(said) + " Hope this helps! 123456", json.dumps(said) * 2]
    pairs = spark.createDataFrame([(t, "{}") for t in texts], "response string, payload string")
    assert [r.reason for r in audit_insights(pairs).collect()] == [None, "malformed_output", "malformed_output"]
    digits = [json.dumps({**said, "summary": f"rose to {n}"}, ensure_ascii=False) for n in ("345678", "٣٤٥٦٧٨", "３４５６７８", "12")]
    pairs = spark.createDataFrame([(t, '{"total": 12}') for t in digits], "response string, payload string")
    assert [r.reason for r in audit_insights(pairs).collect()] == ["hallucinated_numeric_value"] * 3 + [None]
    cited = [json.dumps({**said, "evidence_ids_used": ids}) for ids in ([], ["ev_001"], [None], ["ev_001", None], ["ev_9"])]
    pairs = spark.createDataFrame([(t, "[]", ["ev_001"]) for t in cited], "response string, facts string, known array<string>")
    reasons = [r.reason for r in audit_cited(pairs, "response", "facts", "known").collect()]
    assert reasons == [None, None, "malformed_output", "malformed_output", "unsupported_evidence"]
    intent = '{"intent": "unsupported"}'
    df = spark.createDataFrame([(intent + " thanks",), (intent * 2,)], "response string")
    assert {r.reason for r in validate_intents(df, "question").collect()} == {"invalid_json"}


def test_expected_keys_with_quotes(spark):
    from sumwise.plans.benchmark import matches_expected

    rows = [('{"it\'s": 1, "a.b": "x"}', '{"it\'s": 1.0, "a.b": "x"}', True), ("{}", '{"x\'y]": 1}', False), ("{}", '{"q": null}', True)]
    df = spark.createDataFrame(rows, "a string, e string, ok boolean")
    assert df.where(matches_expected("a", "e") != F.col("ok")).collect() == []


def _one_lookup(spark, kind, rows):
    """`actual` of the lookup for every case, by itself and by joins."""
    inputs = [(f"x{i}", kind, json.dumps(r) if isinstance(r, dict) else r, "{}") for i, r in enumerate(rows)]
    cases = spark.createDataFrame(inputs, "case_id string, category string, input string, expected string")
    joined = {"column_resolution": benchmark._column_cases, "period_resolution": benchmark._period_cases, "semantic_resolution": benchmark._semantic_cases}
    own = benchmark.evaluate_cases(cases)
    return [{r["case_id"]: r["actual"] for r in df.collect()} for df in (own, joined[kind](cases))]


COLUMN_LISTS = [
    ["Rev", "Cost"], ["rev", "REV", "Rev", "rev"], [], ["Revenue", "Revenues", "revenue s", "x"], [None, "Revenues", None, "REVENUES", "Revenues"], ["ab", "abc", "b"],
    ["Sales Amount", "Unit Price", "Total Sales Net"], ["net", "gross net", "the"], ["quantity sold", "Qty Sold", "count", "Qty Sold"], [""], [" "], ["İstanbul", "ß"], None,
]
HINTS = ["rev", " Revenue ", "revenues", "", "  ", None, "ac", "ab", "total sales", "units", "units sold", "net", "price of units", "the", "istanbul", "SS"]


@pytest.mark.parametrize("kind, hint, names", [("column_resolution", "column_hint", "column_names"), ("semantic_resolution", "term", "schema_columns")])
def test_a_case_by_itself_finds_what_joins_find(spark, kind, hint, names):
    def listed(columns):
        return columns if columns is None or kind == "column_resolution" else [{"name": c} for c in columns]

    rows = [{hint: h, names: listed(c)} for h in HINTS for c in COLUMN_LISTS] + [{hint: "rev"}, {names: listed(["Rev"])}, {hint: "rev", names: "Rev"}, "{", "[]"]
    own, joined = _one_lookup(spark, kind, rows)
    assert own == joined and len(own) == len(rows)
    assert {json.loads(a).get("reason") for a in own.values()} == {None, "ambiguous_column", "column_not_found"}


def test_a_period_by_itself_is_what_joins_find(spark):
    labels = [["2023-05", "2024-05", "2024-06"], ["2024-05", "2024-05"], ["May", "2024-05", None], ["5", "Q1", "2023-12"], [], None]
    hints = ["May", " may 2024 ", "05 2024", "5", "2024-05", "Q1", "dec", "December 2023", "june", "13", "", None, "٥", "May 24", "0000"]
    rows = [{"period_hint": h, "period_labels": p} for h in hints for p in labels] + [{"period_hint": "May"}, {"period_hint": "May", "period_labels": "2024-05"}, "{"]
    own, joined = _one_lookup(spark, "period_resolution", rows)
    assert own == joined and len(own) == len(rows)
    assert {json.loads(a).get("reason") for a in own.values()} == {None, "ambiguous_period", "period_not_found"}


def test_only_cases_that_share_an_id_are_joined(spark, monkeypatch):
    """Their lists are one, as before; an id that is null is an id."""
    said = json.dumps({"column_hint": "rev", "column_names": ["Rev"]})
    ids = ["a", "b", "b", None, None, "c"]
    cases = spark.createDataFrame([(i, "column_resolution", said, '{"found": true}') for i in ids], "case_id string, category string, input string, expected string")
    seen, joined = [], benchmark._column_cases
    monkeypatch.setattr(benchmark, "_column_cases", lambda c: seen.extend(r["case_id"] for r in c.collect()) or joined(c))
    got = [(r["case_id"], r["passed"]) for r in benchmark.evaluate_cases(cases).collect()]
    assert sorted(got, key=str) == sorted([("a", True), ("b", False), ("b", False), (None, False), (None, False), ("c", True)], key=str)
    assert sorted(seen, key=str) == sorted(["b", "b", None, None], key=str)
