from __future__ import annotations

import random
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sumwise.functions import change, jsontext, periods, text


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in TYPES(values)))
    return df.select(expression.alias("x")).first()["x"]


def TYPES(values):
    return [(n, "string" if isinstance(v, str) or v is None else "double") for n, v in values.items()]


def test_whitespace_is_what_python_strips():
    assert all(c.isspace() for c in text.WHITESPACE)
    assert len(set(text.WHITESPACE)) == sum(chr(i).isspace() for i in range(0x110000))


CELLS = {
    None: (None, None, None, False, None),
    "": (None, "", None, False, None),
    "  ": (None, "  ", None, False, None),
    "42": (42.0, None, "numeric", True, None),
    "-7.5": (-7.5, None, "numeric", True, None),
    "8.125": (None, "8.125", None, False, "ambiguous_decimal_or_thousands"),
    "12,345.678": (12345.678, None, "numeric", True, None),
    "1,23": (None, "1,23", None, False, "ambiguous_thousands_separator"),
    " 9 ": (9.0, None, "numeric", True, None),
    "$1,250": (1250.0, None, "currency", True, None),
    "99 €": (99.0, None, "currency", True, None),
    "$-3": (-3.0, None, "currency", True, None),
    "-$3": (None, "-$3", None, False, "unsupported_currency_symbol_position"),
    "₹10": (None, "₹10", None, False, "unrecognized_currency_symbol"),
    "$€1": (None, "$€1", None, False, "multiple_currency_symbols"),
    "$abc": (None, "$abc", None, False, "invalid_currency_format"),
    "$1.125": (None, "$1.125", None, False, "ambiguous_decimal_or_thousands"),
    "25%": (0.25, None, "percentage", True, None),
    "%25": (None, "%25", None, False, "invalid_percentage_format"),
    "5%%": (None, "5%%", None, False, "invalid_percentage_format"),
    "2.125%": (None, "2.125%", None, False, "ambiguous_decimal_or_thousands"),
    "2025-02-03": (None, "2025-02-03", "date", False, None),
    "2025-2-3": (None, "2025-02-03", "date", True, None),
    "2025/11/9": (None, "2025-11-09", "date", True, None),
    "february 3, 2025": (None, "2025-02-03", "date", True, None),
    "3 February  2025": (None, "2025-02-03", "date", True, None),
    "30 February 2025": (None, "30 February 2025", None, False, None),
    "03/04/2025": (None, "03/04/2025", None, False, "ambiguous_date_format"),
    "1-2-25": (None, "1-2-25", None, False, "ambiguous_date_format"),
    " north ": (None, " north ", None, False, None),
}


def test_cells(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "raw string")
    for r in text.read_cells(df, {"raw": "f"}).collect():
        f = r["f"]
        assert (f["num"], f["text"], f["type"], f["was_changed"], f["warning"]) == CELLS[r["raw"]], r["raw"]
        assert f["is_ambiguous"] == (f["warning"] is not None)


def test_every_currency_symbol_is_seen(spark):
    symbols = [chr(i) for i in range(0x3000) if unicodedata.category(chr(i)) == "Sc"]
    df = spark.createDataFrame([(s + "1",) for s in symbols], "raw string")
    for r in text.read_cells(df, {"raw": "f"}).collect():
        known = r["raw"][0] in "$€£¥"
        assert (r["f"]["num"] == 1.0) == known
        assert r["f"]["is_ambiguous"] == (not known)


def test_a_filter_on_findings_does_not_repeat_the_rules(spark):
    df = text.read_cells(spark.range(10).select(F.col("id").cast("string").alias("raw")), {"raw": "f"})
    plan = df.where("f.is_ambiguous")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1
    assert "RLIKE" not in plan.split("Filter")[1].split("\n")[0]


def test_double_text_is_python_text(spark):
    random.seed(7)
    values = [0.0, 1.0, 1e7, 123456789.25, 1e15, 1e16, 1.5e22, 1e-4, 9.9e-5, 0.001, -2.5e-7, 460000.0]
    values += [random.choice([-1, 1]) * random.random() * 10 ** random.randint(-8, 18) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    shown = [r["t"] for r in df.select("d", text.double_text("d").alias("t")).collect()]
    assert [float(t) for t in shown] == values
    assert sum(t == repr(v) for t, v in zip(shown, values, strict=True)) >= len(values) - 3


@pytest.mark.parametrize(
    "hint, month_year, alone",
    [
        ("March 2024", "2024-03", None),
        ("sept  1999", "1999-09", None),
        ("03 2024", "2024-03", None),
        (" mar ", None, 3),
        ("12", None, 12),
        ("13", None, None),
        ("March 24", None, None),
        ("a b c", None, None),
        ("", None, None),
    ],
)
def test_month_hints(spark, hint, month_year, alone):
    assert one(spark, periods.month_and_year("h"), h=hint) == month_year
    assert one(spark, periods.lone_month("h"), h=hint) == alone


def test_labels(spark):
    assert one(spark, periods.next_label("p", 2), p="2023-11") == "2024-01"
    assert one(spark, periods.next_label("p", 1), p="soon") is None
    assert one(spark, periods.month_of_label("p"), p="2023-07") == 7
    assert one(spark, periods.month_of_label("p"), p="2023-7") is None


@pytest.mark.parametrize(
    "p, c, diff, pct, valid, reason",
    [
        (100.0, 150.0, 50.0, 50.0, True, None),
        (-4.0, 2.0, 6.0, -150.0, True, None),
        (0.0, 0.0, 0.0, 0.0, True, None),
        (0.0, 5.0, 5.0, None, False, "division_by_zero"),
        (None, 5.0, None, None, False, "missing_value"),
        (float("nan"), 5.0, None, None, False, "missing_value"),
    ],
)
def test_change(spark, p, c, diff, pct, valid, reason):
    df = spark.createDataFrame([(p, c)], "p double, c double")
    r = df.select(change.change("p", "c").alias("x")).first()["x"]
    assert (r["absolute_change"], r["percentage_change"], r["is_valid"], r["reason"]) == (diff, pct, valid, reason)


def test_json_leaves(spark):
    j = r'{"k1": 12.5, "list": ["Plan_7", "q\"9x", true, null, 3, 1e3], "deep": {"s\\": "2024-05", "n": -42}, "e": "a\\"}'
    df = spark.createDataFrame([(j,)], "j string")
    r = df.select(
        jsontext.json_numbers("j").alias("n"), jsontext.json_strings("j").alias("s"), jsontext.json_labels("j").alias("l")
    ).first()
    assert sorted(r["n"]) == [-42.0, 12.5, 1000.0]
    assert r["s"] == ["Plan_7", 'q"9x', "2024-05", "a\\"]
    assert r["l"] == ["Plan_7", 'q"9x']


def test_numbers_in_text(spark):
    t = "Plan_70 in 2024-05-01T10:00:00 made 1,234.5, then -42 and 3; Plan_70 again, 70."
    df = spark.createDataFrame([(t,)], "t string")
    plain = df.select(jsontext.text_numbers("t").alias("x")).first()["x"]
    masked = df.select(jsontext.text_numbers("t", F.array(F.lit("Plan_70"))).alias("x")).first()["x"]
    assert plain == [70.0, 1234.5, -42.0]
    assert masked == [1234.5, -42.0, 70.0]


@pytest.mark.parametrize(
    "cited, known, bad",
    [([99.9], [99.2], []), ([-5.5], [-5.1], []), ([100.0], [99.9], [100.0]), ([1.0000001], [1.0000004], []), ([7.5], [], [7.5])],
)
def test_number_support(spark, cited, known, bad):
    df = spark.createDataFrame([(cited, known)], "c array<double>, k array<double>")
    assert df.select(jsontext.unsupported_numbers(F.col("c"), F.col("k")).alias("x")).first()["x"] == bad


def test_timestamps(spark):
    values = ["2024-05-06", "May 6, 2024", "2024-05-06 07:08:09", "2024-05-06T07:08:09.5", "later", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["t"] for r in df.select(text.parse_timestamp("v").alias("t")).collect()]
    day = datetime(2024, 5, 6)
    assert got == [day, day, datetime(2024, 5, 6, 7, 8, 9), datetime(2024, 5, 6, 7, 8, 9, 500000), None, None]


def test_a_text_is_trimmed_once(spark):
    """Rules and readings use the trimmed text many times; none of them trims the cell again."""
    from sumwise.operators.profile import column_facts

    cells = spark.range(3).select(F.concat(F.lit(" "), F.col("id").cast("string"), F.lit(" ")).alias("t"))
    plan = column_facts(cells)._jdf.queryExecution().optimizedPlan().toString()
    # For its rules and its readings, and without the marks around a number; written out in full it was 290 times.
    assert 0 < plan.count("trim(") <= 8


def test_texts_that_start_like_a_date_reach_the_date_parser(spark):
    """The cheap test before the four shapes leaves none of their texts out."""
    good = ["2024-1-5", "2024/01/05", "January 5, 2024", "January\t\t5,  2024", "5 January 2024", "05\n January 2024"]
    bad = ["O-123", "x", "", "January", "5 January", "1234.56", "03/04/2024", "20240105", "2024-1-5 x", "-2024-1-5"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = {r.t: str(r.d) for r in df.select("t", text.parse_date("t").alias("d")).collect()}
    assert got == {**dict.fromkeys(good, "2024-01-05"), **dict.fromkeys(bad, "None")}
