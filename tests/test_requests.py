from __future__ import annotations

import difflib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sumwise.operators import resolve, similar
from sumwise.plans import analysis, charts, comparison, explained, questions
from conftest import by


def columns(spark, *names, dataset="d"):
    return spark.createDataFrame([(dataset, i, n) for i, n in enumerate(names)], "dataset_id string, position int, name string")


def ask(spark, field, *hints):
    return spark.createDataFrame([(i, "d", h) for i, h in enumerate(hints)], f"id int, dataset_id string, {field} string")


def test_columns(spark):
    known = columns(spark, "Revenue", "Units", "units", "Colour", "Colours")
    got = by(resolve.resolve_column(ask(spark, "column_hint", " REVENUE ", "revenu", "Units", "colou", "rev", "", None), known))
    assert [got[i]["column"] for i in range(7)] == ["Revenue", "Revenue", None, None, None, None, None]
    assert got[2]["reason"] == "ambiguous_column" and got[2]["candidates"] == ["Units", "units"]
    assert got[3]["candidates"] == ["Colour", "Colours"]
    assert {got[i]["reason"] for i in (4, 5, 6)} == {"column_not_found"}


def test_similar_columns_match_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    hints = [n[: rng.randint(1, len(n))] + rng.choice(["", "a", "b", "cd"]) for n in names]
    got = by(resolve.resolve_column(ask(spark, "column_hint", *hints), columns(spark, *names)))
    for i, h in enumerate(hints):
        exact = [n for n in names if n == h]
        close = exact if exact else list(dict.fromkeys(difflib.get_close_matches(h, names, len(names), 0.8)))
        if len(close) == 1:
            assert got[i]["column"] == close[0], h
        else:
            assert got[i]["column"] is None and got[i]["candidates"] == close, h


def texts(spark, values):
    return spark.createDataFrame([("d", v) for v in dict.fromkeys(values)], "dataset_id string, text string")


def test_alike_pairs_match_brute_force(spark):
    """Every pair of many short and long texts, over alphabets of two to eight letters and with blanks and accents."""
    rng = random.Random(6)
    some = ["", "a", "ab", "axb", "ba", "xab", "aab", "é ü", "é", "éüa"]
    for letters in ("ab", "abcd", "abcde gé", "aé "):
        some += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(70)]
    for t in rng.sample(some, 120):  # edits of the texts: letters that go, come and change
        t = list(t)
        for _ in range(rng.randint(1, 4)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "b", "c", "zz"])
        some.append("".join(t))
    some = list(dict.fromkeys(some))
    left, right = some[::2], some[1::2]
    got = {(r["a_text"], r["b_text"]): r["score"] for r in similar.alike_pairs(texts(spark, left), texts(spark, right), ["dataset_id"]).collect()}
    want = {}
    for a in left:
        for b in right:
            score = difflib.SequenceMatcher(None, b, a).ratio()
            if score >= 0.8 and a != b:
                want[a, b] = score
    assert len(want) > 60 and got == want


def test_few_pairs_are_compared(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    names = [f"{rng.choice(words)} {rng.choice(words)} {rng.choice(words)}" for _ in range(400)]
    hints = [n[:3] + n[4:] for n in rng.choices(names, k=300)] + [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(300)]
    near = sum(max(len(a), len(b)) * 2 <= min(len(a), len(b)) * 3 for a in set(hints) for b in set(names))
    compared = similar.candidate_pairs(texts(spark, hints), texts(spark, names), ["dataset_id"]).count()
    assert 0 < compared * 10 < near


def test_candidates_as_rows(spark):
    known = columns(spark, *[f"Column {i:04d}" for i in range(300)], "Units", "units", "Units", "Colour", "Colours")
    asked = ask(spark, "column_hint", "column 01x0", "UNITS", "colou", "Colour", "nothing", None, "units ")
    rows = resolve.column_candidates(asked, known).collect()
    lists = by(resolve.resolve_column(asked, known))
    counts = by(resolve.resolve_column(asked, known, lists=False))
    for i, hint in enumerate(["column 01x0", "UNITS", "colou", "Colour", "nothing", "", "units"]):
        found = [r["name"] for r in sorted((r for r in rows if r["column_hint"] == hint), key=lambda r: r["rank"])]
        assert found == lists[i]["candidates"] and counts[i]["candidate_count"] == len(found), hint
        assert (counts[i]["reason"], counts[i]["column"]) == (lists[i]["reason"], lists[i]["column"])
    assert counts[0]["candidate_count"] > 100 and counts[1]["candidate_count"] == 3
    plan = resolve.resolve_column(asked, known, lists=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan.replace("map_from_entries(collect_list", "") and "CartesianProduct" not in plan


def test_semantic_and_file_candidates_as_rows(spark):
    known = columns(spark, "Sales Amount", "Net Revenue", "Units Sold", "Ship Cost", "Ship Price", "Sales", "sales")
    asked = ask(spark, "term", "total sales", "price", "sales", "net revenue units", "the", "revenue cost")
    lists = by(resolve.resolve_semantic_column(asked, known))
    counts = by(resolve.resolve_semantic_column(asked, known, lists=False))
    rows = resolve.semantic_candidates(asked, known).collect()
    for i, hint in enumerate(["total sales", "price", "sales", "net revenue units", "the", "revenue cost"]):
        found = [(r["name"], r["confidence"]) for r in sorted((r for r in rows if r["term"] == hint), key=lambda r: r["rank"])]
        assert found == [tuple(c) for c in lists[i]["candidates"]] and counts[i]["candidate_count"] == len(found), hint
        assert tuple(counts[i])[3:7] == tuple(lists[i])[3:7]
    files = spark.createDataFrame([("2", "a", "current"), ("1", "b", "current"), ("3", "a", None)], "dataset_id string, display_name string, role string")
    asked = ask(spark, "file_hint", "Current", "A", "b", "previous", " ").drop("dataset_id")
    got = {(r["file_hint"], r["rank"]): r["dataset_id"] for r in resolve.file_candidates(asked, files).collect()}
    assert got == {("current", 1): "1", ("current", 2): "2", ("a", 1): "2", ("a", 2): "3"}
    assert [by(resolve.resolve_file(asked, files, lists=False))[i]["candidate_count"] for i in range(5)] == [2, 2, 0, 0, 0]


def test_equal_names_are_compared_once(spark):
    """Columns of one name are counted for what a term settles, and listed only where candidates are rows."""
    known = columns(spark, *["Ship Cost"] * 40, *["ship price"] * 2, "Units")
    asked = ask(spark, "term", "price", "cost of units", "ship cost", "shipcost")
    counts = by(resolve.resolve_semantic_column(asked, known, lists=False))
    assert [counts[i]["candidate_count"] for i in range(4)] == [42, 0, 40, 0]
    lists = by(resolve.resolve_semantic_column(asked, known))
    for i in range(4):
        best = [c["confidence"] for c in lists[i]["candidates"] if c["confidence"] is not None]
        assert len(lists[i]["candidates"]) == counts[i]["candidate_count"] and counts[i]["best"] == max(best, default=None)
    hints = asked.select("dataset_id", F.col("term").alias("__hint"))
    assert resolve._word_names(hints, known, ["dataset_id"]).groupBy("__hint").count().agg(F.max("count")).first()[0] <= 3
    names = resolve.hint_names(hints, known, ["dataset_id"]).where("__hint = 'ship cost'").collect()
    assert [(r["name"], r["copies"], r["position"]) for r in names] == [("Ship Cost", 40, 0)]


def test_periods(spark):
    labels = spark.createDataFrame([("d", p) for p in ("2023-03", "2024-03", "2024-05")], "dataset_id string, period string")
    hints = ["2024-03", "March 2023", "mar", "May", "5 2024", "June 2024", "2024", None]
    got = by(resolve.resolve_period(ask(spark, "period_hint", *hints), labels))
    assert [got[i]["period"] for i in range(8)] == ["2024-03", "2023-03", None, "2024-05", "2024-05", None, None, None]
    assert got[2]["candidates"] == ["2023-03", "2024-03"] and got[2]["reason"] == "ambiguous_period"
    years = by(resolve.resolve_year(ask(spark, "period_hint", "2024", "1990", "May", None), labels))
    assert years[0]["periods"] == ["2024-03", "2024-05"]
    assert [years[i]["reason"] for i in (1, 2, 3)] == ["period_not_found", "not_a_year", "not_a_year"]


def test_semantic_columns(spark):
    known = columns(spark, "Sales Amount", "Net Revenue", "Units Sold", "Ship Cost")
    hints = ["total sales", "units", "price", "sales amount", "the", "nothing here", "net revenue units"]
    got = by(resolve.resolve_semantic_column(ask(spark, "term", *hints), known))
    assert (got[0]["column"], got[0]["confidence"]) == ("Sales Amount", 1.0)
    assert (got[1]["column"], got[1]["confidence"]) == ("Units Sold", 0.6667)
    assert got[2]["reason"] == "ambiguous_column" and got[2]["candidates"][0]["column"] == "Ship Cost"
    assert got[3]["confidence"] == 1.0
    assert got[4]["reason"] == got[5]["reason"] == "column_not_found"


def test_files(spark):
    known = spark.createDataFrame(
        [("1", "a.csv", "previous"), ("2", "A.CSV", None), ("3", "b.csv", "current"), ("4", "c.csv", "current")],
        "dataset_id string, display_name string, role string",
    )
    asked = ask(spark, "file_hint", "Previous", "current", "reference", "b.csv", "a.csv", "b", " ")
    got = by(resolve.resolve_file(asked.drop("dataset_id"), known))
    assert [got[i]["dataset_id"] for i in range(7)] == ["1", None, None, "3", None, None, None]
    assert [got[i]["reason"] for i in (1, 2, 4, 5, 6)] == [
        "duplicate_role", "role_not_assigned", "duplicate_role", "file_not_found", "file_not_found",
    ]


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for d, base in (("old", 10.0), ("new", 20.0)):
        for m in range(1, 13):
            rows.append((d, datetime(2024, m, 5), base + m if m != 6 else 500.0, m, None if m == 2 else "x"))
    df = spark.createDataFrame(rows, "dataset_id string, day timestamp_ntz, amount double, units int, note string")
    return analysis.analyze(df, ["dataset_id"], "amount", "day").kept()


QUESTION = "request_id int, dataset_id string, intent string, metric string, column_hint string, period_hint string, from_period_hint string, to_period_hint string"


def test_questions(spark, found):
    none = [None] * 6
    asked = [
        ("old", "period_value", None, None, "March 2024", None, None),
        ("old", "period_value", None, "Units", "2024-03", None, None),
        ("old", "period_extremum", "max", "amount", None, None, None),
        ("old", "period_change", None, None, None, "Jan", "Feb"),
        ("old", "period_change", None, None, None, "Jan", "Mar"),
        ("new", "column_stat", "count", "UNITS", None, None, None),
        ("new", "column_stat", "sum", None, "2024", None, None),
        ("new", "column_stat", "mean", None, "2024", None, None),
        ("new", "column_stat", "sum", None, "1999", None, None),
        ("new", "anomaly_check", None, None, None, None, None),
        ("new", "missing_values", None, None, None, None, None),
        ("gone", "missing_values", None, None, None, None, None),
        ("gone", "anomaly_check", None, None, None, None, None),
        ("old", "sing", *none[1:]),
    ]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], QUESTION)
    answers = questions.with_answers(questions.answer_questions(df, found))
    got = by(answers, "request_id")
    assert [got[i]["answer"] for i in (0, 2, 3, 5, 6, 9, 10)] == [
        "amount in 2024-03 was 13.0.",
        "The highest value of amount was 500.0, in 2024-06.",
        f"amount changed from 11.0 in 2024-01 to 12.0 in 2024-02, a change of 1.0 ({1 / 11 * 100}%).",
        "The count of units is 12.",
        "The sum of amount is 792.0.",
        "1 anomaly detected for amount.",
        "Columns with missing values: note (1 missing).",
    ]
    assert [got[i]["reason"] for i in (1, 4, 7, 8, 11, 12, 13)] == [
        "column_series_mismatch", "period_not_found", "unsupported", "period_not_found", "profile_not_computed",
        "trend_not_computed", "unsupported",
    ]
    assert got[4]["extra"]["to_period"] == "2024-03"

    written = spark.createDataFrame(
        [(0, '{"summary": "It was 13.0.", "key_insights": [], "trend_interpretation": null, "warnings": [], "recommendations": [], "evidence_ids_used": ["ev_001"]}'),
         (1, "x"), (2, '{"summary": 1}')],
        "request_id int, response string",
    )
    told = by(explained.explain_answers(answers, written), "request_id")
    assert told[0]["explanation"]["is_valid"] and told[0]["evidence_text"] == "amount in 2024-03 was 13.0."
    assert told[1]["explanation"] is None and told[1]["evidence_json"] is None
    assert told[2]["explanation"]["reason"] == "malformed_output"
    assert told[3]["explanation"] is None and told[3]["evidence_id"] == "ev_001"
    assert all(told[i]["answer"] == got[i]["answer"] for i in range(len(asked)))


def test_comparisons(spark, found):
    known = spark.createDataFrame(
        [("old", "2023.csv", "previous"), ("new", "2024.csv", "current"), ("bare", "bare.csv", None)],
        "dataset_id string, display_name string, role string",
    )
    asked = [
        ("file_value_comparison", "amount", "sum", None, "previous", "current"),
        ("file_value_comparison", "amont", "count", None, "2023.csv", "2024.CSV"),
        ("file_period_comparison", None, None, "May", "previous", "current"),
        ("file_trend_comparison", None, None, None, "previous", "current"),
        ("file_anomaly_comparison", None, None, None, "previous", "current"),
        ("file_value_comparison", "amount", "sum", None, "previous", "bare.csv"),
        ("file_trend_comparison", None, None, None, "previous", "bare.csv"),
        ("file_value_comparison", "amount", "sum", None, "previous", "2023.csv"),
        ("dance", "amount", "sum", None, "previous", "current"),
    ]
    df = spark.createDataFrame(
        [(i, *a) for i, a in enumerate(asked)],
        "request_id int, intent string, column_hint string, metric string, period_hint string, from_file_hint string, to_file_hint string",
    )
    results = comparison.with_comparison_answers(comparison.compare_datasets(df, known, found))
    got = by(results, "request_id")
    assert (got[0]["previous_num"], got[0]["current_num"], got[0]["absolute_change"]) == (682.0, 792.0, 110.0)
    assert got[1]["answer"].startswith("The count of amount for 2024.csv is 12, compared with 12 for 2023.csv, a change of 0 (0.0%)")
    assert got[2]["period"] == "2024-05" and got[2]["absolute_change"] == 10.0
    assert (got[3]["previous_label"], got[3]["is_valid"]) == ("volatile", True)
    assert got[4]["answer"] == "2023.csv has 1 anomaly, 2024.csv has 1 — a change of 0."
    assert [got[i]["reason"] for i in (5, 6, 7, 8)] == [
        "column_not_found_in_file_b", "trend_not_computed_in_file_b", "insufficient_files", "unsupported_comparison",
    ]
    public = by(comparison.public_identity(results), "request_id")
    assert public[0]["file_a"].asDict() == {"display_name": "2023.csv", "role": "previous"} and public[7]["file_a"] is None
    bars = by(charts.comparison_charts(results), "request_id")
    assert [(p["x"], p["y"]) for p in bars[0]["points"]] == [("2023.csv", 682.0), ("2024.csv", 792.0)]
    assert bars[2]["reason"] == "unsupported_comparison"


def test_candidates_come_from_the_side_that_failed(spark, found):
    known = spark.createDataFrame(
        [("old", "a.csv", "current"), ("new", "b.csv", "current"), ("bare", "c.csv", "reference")],
        "dataset_id string, display_name string, role string",
    )
    sides = [("previous", "current"), ("current", "reference"), ("reference", "current"), ("nowhere", "current")]
    asked = [(i, "file_value_comparison", "amount", "sum", None, *s) for i, s in enumerate(sides)] + [(4, "dance", None, None, None, "current", "current")]
    df = spark.createDataFrame(
        asked,
        "request_id int, intent string, column_hint string, metric string, period_hint string, from_file_hint string, to_file_hint string",
    )
    got = by(comparison.compare_datasets(df, known, found), "request_id")
    told = {i: (r["reason"], sorted(r["extra"]["candidates"] or [])) for i, r in got.items()}
    both = ["new", "old"]
    assert told == {
        0: ("role_not_assigned", []), 1: ("duplicate_role", both), 2: ("duplicate_role", both), 3: ("file_not_found", []), 4: ("unsupported_comparison", []),
    }


def test_similarity_runs_where_the_package_is_not_installed(tmp_path):
    """Worker functions travel by value; the script below starts in another folder, its workers find no `sumwise`."""
    import os
    import subprocess
    import sys

    script = tmp_path / "job.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from sumwise.session import local_session
from sumwise.operators.resolve import resolve_column
spark = local_session(2, 2)
asked = spark.createDataFrame([(1, "d", "Revenu")], "id int, dataset_id string, column_hint string")
names = spark.createDataFrame([("d", 0, "Revenue"), ("d", 1, "Cost")], "dataset_id string, position int, name string")
assert resolve_column(asked, names).first()["column"] == "Revenue"
print("resolved")
"""
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "resolved" in done.stdout, done.stderr[-2000:]


def test_charts(spark, found):
    asked = [
        ("old", "trend_chart", None, None, None, None, None),
        ("old", "trend_chart", None, None, "1990", None, None),
        ("old", "numeric_summary_chart", "std", "amount", None, None, None),
        ("old", "numeric_summary_chart", None, None, None, None, None),
        ("old", "period_change_chart", None, None, None, "Jan", None),
        ("old", "period_change_chart", None, None, None, "Jan", "Feb"),
        ("old", "missing_values_chart", None, None, None, None, None),
        ("gone", "period_change_chart", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], QUESTION)
    got = by(charts.chart_specs(df, found), "request_id")
    assert len(got[0]["points"]) == 12 and [p["x"] for p in got[0]["points"] if p["direction"]] == ["2024-06"]
    assert [got[i]["reason"] for i in (1, 3, 4, 7)] == [
        "period_not_found", "column_required", "period_range_incomplete", "period_comparison_not_computed",
    ]
    assert got[2]["metric"] == "std"
    assert [(p["x"], p["y"]) for p in got[5]["points"]] == [("2024-01 → 2024-02", 1.0)]
    assert [p["x"] for p in got[6]["points"]] == ["day", "amount", "units", "note"]


def test_one_hot_hint_is_resolved_once(spark):
    """Many requests that share a hint send one row to the similarity step."""
    asked = spark.range(5000).select("id", F.lit("d").alias("dataset_id"), F.lit("Revenu").alias("column_hint"))
    df = resolve.resolve_column(asked, columns(spark, "Revenue", "Cost"))
    assert df.groupBy("column").count().collect() == [("Revenue", 5000)]


def test_candidates_as_one_text_are_joined_before_the_requests_get_them(spark):
    asked = spark.range(100).select("id", F.lit("d").alias("dataset_id"), F.element_at(F.array(F.lit("cost"), F.lit("total"), F.lit("zzz")), (F.col("id") % 3 + 1).cast("int")).alias("column_hint"))
    names = columns(spark, "Cost", "Total", "COST")
    df = resolve.resolve_column(asked, names, separator=";")
    lists = resolve.resolve_column(asked, names).withColumn("candidates", F.array_join("candidates", ";"))
    assert df.columns == lists.columns and sorted(map(str, df.collect())) == sorted(map(str, lists.collect()))
    assert {r["candidates"] for r in df.collect()} == {"Cost;COST", ""}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("array_join(")


def _repeated(spark, *fields):
    """1,000 requests, half of them with one content and half with another; NULL and the empty text differ."""
    return spark.range(1000).select(F.col("id").cast("int").alias("request_id"), *[F.when(F.col("id") % 2 == 0, a).otherwise(b).cast("string").alias(n) for n, a, b in fields])


def test_equal_questions_are_answered_and_audited_once(spark, found, monkeypatch):
    none = F.lit(None)
    asked = _repeated(
        spark, ("dataset_id", F.lit("old"), F.lit("old")), ("intent", F.lit("anomaly_check"), F.lit("anomaly_check")), ("metric", none, none), ("column_hint", none, F.lit("")),
        ("period_hint", none, none), ("from_period_hint", none, none), ("to_period_hint", none, none),
    )
    seen = []

    def then(results):
        seen.append(results.count())
        return questions.with_answers(results)

    answers = questions.answer_questions(asked, found, then=then)
    assert seen == [2] and answers.columns[0] == "request_id"
    told = answers.groupBy("answer").count().collect()
    assert [(r["answer"], r["count"]) for r in told] == [("1 anomaly detected for amount.", 1000)]
    audit = explained.audit_cited
    monkeypatch.setattr(explained, "audit_cited", lambda pairs, *rest: seen.append(pairs.count()) or audit(pairs, *rest))
    written = asked.select("request_id", F.lit("no JSON").alias("response"))
    rows = explained.explain_answers(answers, written).groupBy("explanation.reason").count().collect()
    assert seen == [2, 1] and [tuple(r) for r in rows] == [("malformed_output", 1000)]


def test_equal_charts_and_responses_are_made_once(spark, found, monkeypatch):
    none = F.lit(None)
    asked = _repeated(
        spark, ("dataset_id", F.lit("old"), F.lit("gone")), ("intent", F.lit("trend_chart"), F.lit("trend_chart")), ("metric", none, none), ("column_hint", none, none),
        ("period_hint", none, none), ("from_period_hint", none, none), ("to_period_hint", none, none),
    )
    seen = []
    ground, validate = charts.ground, questions.validate_intents
    monkeypatch.setattr(charts, "ground", lambda q, *rest: seen.append(q.count()) or ground(q, *rest))
    monkeypatch.setattr(questions, "validate_intents", lambda q, *rest: seen.append(q.count()) or validate(q, *rest))
    drawn = charts.chart_specs(asked, found).groupBy(F.size("points"), "reason").count().collect()
    assert sorted(map(tuple, drawn), key=str) == [(0, "trend_not_computed", 500), (12, None, 500)]
    said = asked.select("request_id", "dataset_id", F.lit("no JSON").alias("response"))
    rows = questions.answer_responses(said, found).groupBy("dataset_id", "reason").count().collect()
    assert sorted(map(tuple, rows)) == [("gone", "invalid_json", 500), ("old", "invalid_json", 500)] and seen == [2, 2]


def test_equal_comparisons_are_made_once(spark, found):
    known = spark.createDataFrame([("old", "a.csv", "previous"), ("new", "b.csv", "current")], "dataset_id string, display_name string, role string")
    none = F.lit(None)
    asked = _repeated(
        spark, ("intent", F.lit("file_value_comparison"), F.lit("dance")), ("column_hint", F.lit("amount"), none), ("metric", F.lit("sum"), none), ("period_hint", none, none),
        ("from_file_hint", F.lit("previous"), none), ("to_file_hint", F.lit("current"), none),
    )
    seen = []

    def then(results):
        seen.append(results.count())
        return comparison.with_comparison_answers(results)

    rows = comparison.compare_datasets(asked, known, found, then=then).groupBy("reason", "absolute_change").count().collect()
    assert seen == [2] and sorted(map(tuple, rows), key=str) == [("unsupported_comparison", None, 500), (None, 110.0, 500)]


def test_payload(spark, found):
    p = analysis.analytics_payload(found, with_profile=True).first()["payload"]
    assert '"profile":[{"name":"day"' in p and "date_summary" not in p
    assert {r["name"] for r in analysis.known_columns(found).collect()} == {"amount", "units"}


def test_from_response_to_answer(spark, found):
    import json

    def intent(**fields):
        keys = ["intent", "metric", "column_hint", "period_hint", "from_period_hint", "to_period_hint"]
        return json.dumps({**dict.fromkeys(keys), **fields})

    value = intent(intent="column_stat", metric="sum", column_hint="amount")
    said = [(0, "old", value, None), (1, "old", value + " thanks", None), (2, "old", '{"intent": "column_stat"}', None), (3, "old", value, "provider_error"), (4, "old", None, None)]
    df = spark.createDataFrame(said, "request_id int, dataset_id string, response string, provider_error string")
    got = by(questions.answer_responses(df, found), "request_id")
    assert got[0]["answer"] == "The sum of amount is 682.0." and got[0]["found"]
    assert [got[i]["reason"] for i in (1, 2, 3, 4)] == ["invalid_json", "invalid_schema", "provider_error", "invalid_json"]
    assert got[1]["answer"] == "The question couldn't be interpreted (the AI response wasn't valid JSON)."
    known = spark.createDataFrame(
        [("old", "2023.csv", "previous"), ("new", "2024.csv", "current")], "dataset_id string, display_name string, role string"
    )
    keys = ["intent", "metric", "column_hint", "period_hint", "from_file_hint", "to_file_hint"]
    pair = json.dumps(dict(zip(keys, ["file_value_comparison", "sum", "amount", None, "previous", "current"])))
    df = spark.createDataFrame([(0, pair), (1, pair + "x")], "request_id int, response string")
    both = by(comparison.compare_responses(df, known, found), "request_id")
    assert both[0]["found"] and both[0]["absolute_change"] == 110.0
    assert (both[1]["reason"], both[1]["answer"]) == ("invalid_json", got[1]["answer"])


def test_the_question_may_be_cited(spark, found):
    import json

    asked = spark.createDataFrame([(0, "old", "column_stat", "sum", "amount", None, None, None)], "request_id int, " + QUESTION.split(", ", 1)[1])
    answers = questions.with_answers(questions.answer_questions(asked, found))
    text = json.dumps({"summary": "You asked about Plan_777123.", "key_insights": [], "trend_interpretation": None, "warnings": [], "recommendations": [], "evidence_ids_used": []})
    written = spark.createDataFrame([(0, text, "Plan_777123")], "request_id int, response string, question string")
    reasons = [explained.explain_answers(answers, written, question=q).first()["explanation"]["reason"] for q in (None, "question")]
    assert reasons == ["hallucinated_numeric_value", None]
