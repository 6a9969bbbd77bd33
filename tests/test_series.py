from __future__ import annotations

import math
import random
import statistics
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumwise.operators import anomaly, forecast, scan, series as S
from sumwise.operators.quantile import exact_quantiles
from conftest import by

K = ["id"]


def test_monthly_series_sums_and_keeps_gaps(spark):
    rows = [
        ("a", datetime(2024, 1, 3), 10.0),
        ("a", datetime(2024, 1, 30), 5.0),
        ("a", datetime(2024, 4, 1), None),
        ("a", None, 99.0),
        (None, datetime(2024, 2, 1), float("nan")),
    ]
    df = spark.createDataFrame(rows, "id string, day timestamp_ntz, amount double")
    got = {(r["id"], r["period"]): r["value"] for r in S.monthly_series(df, "day", "amount", K).collect()}
    assert got == {("a", "2024-01"): 15.0, ("a", "2024-04"): 0.0, (None, "2024-02"): 0.0}


def test_monthly_series_of_text(spark):
    rows = [("$1,000", "2024-01-05"), ("$500", "January 9, 2024"), (None, "2024-02-01"), ("$7", "some day")]
    df = spark.createDataFrame(rows, "amount string, day string")
    got = {r["period"]: r["value"] for r in S.monthly_series(df, "day", "amount").collect()}
    assert got == {"2024-01": 1500.0, "2024-02": 0.0}


def test_a_measure_with_unreadable_cells_has_no_series(spark):
    rows = [("a", "$10", "2024-01"), ("a", "$20", "2024-02"), ("a", "n/a", "2024-02"), ("b", "$10", "2024/3"), ("b", "1.5", "Mar 2024"), ("b", None, "15-April-2024")]
    rows += [("c", "$3", "2024-05-01T23:30:00+05:30"), ("c", "$4", "2024-05-01T23:30:00Z"), ("d", "1.234", "no day")]
    df = spark.createDataFrame(rows, "k string, amount string, day string")
    got = {(r["k"], r["period"]): r["value"] for r in S.monthly_series(df, "day", "amount", ["k"]).collect()}
    assert got == {("b", "2024-03"): 11.5, ("b", "2024-04"): 0.0, ("c", "2024-05"): 7.0}
    why = [tuple(r) for r in S.unreadable_measures(df, "day", "amount", ["k"]).orderBy("k").collect()]
    assert why == [("a", "amount", "unreadable_values", 1), ("d", "amount", "unreadable_values", 1)]


def test_with_and_without_keys_agree(series):
    df = series(a=[5.0, 7.0, 6.0, 20.0, 5.0])
    plain = df.select("period", "value")
    for op in (S.compare_periods, S.detect_trend, S.volatility, S.rolling_mean, anomaly.iqr_scores, forecast.naive_forecast):
        with_key = op(df, K).drop("id").collect()
        assert sorted(map(str, with_key)) == sorted(map(str, op(plain).collect())), op.__name__


def test_trends(series):
    df = series(
        up=[1.0, 2.0, 3.0], down=[3.0, 2.0, 1.0], flat=[4.0, 4.0], mixed=[1.0, 3.0, 2.0], one=[1.0],
        nulls=[None, None, None], zero=[0.0, 5.0, 6.0],
    )
    t = by(S.detect_trend(df, K))
    assert {k: v["trend"] for k, v in t.items()} == {
        "up": "increasing", "down": "decreasing", "flat": "stable", "mixed": "volatile", "one": "insufficient_data",
        "nulls": "insufficient_data", "zero": "increasing",
    }
    assert (t["zero"]["valid_comparison_count"], t["zero"]["invalid_comparison_count"]) == (1, 1)
    counts = by(S.comparison_counts(df, K))
    assert counts["one"]["insufficient_data"] and not counts["up"]["insufficient_data"]


def test_empty_series(series):
    df = series(a=[1.0]).where("false").drop("id")
    assert S.detect_trend(df).first()["trend"] == "insufficient_data"
    assert S.seasonality_signal(df).first()["insufficient_data"]
    assert anomaly.iqr_summary(df).first()["sample_size"] == 0
    assert forecast.naive_forecast(df).first()["insufficient_data"]
    assert forecast.backtest_forecast(df).first()["reason"] == "insufficient_history"


def test_null_keys_form_a_series(spark):
    df = spark.createDataFrame([(None, "2024-01", 1.0), (None, "2024-02", 2.0)], "id string, period string, value double")
    assert S.detect_trend(df, K).first()["trend"] == "increasing"


def test_volatility(series):
    v = by(S.volatility(series(a=[100.0, 110.0, 99.0, 120.0], b=[1.0, 2.0], c=[0.0, 1.0, 2.0, 3.0]), K))
    rates = [10.0, -10.0, (120 - 99) / 99 * 100]
    assert math.isclose(v["a"]["value"], statistics.stdev(rates))
    assert v["b"]["insufficient_data"] and v["b"]["value"] is None
    assert math.isclose(v["c"]["value"], statistics.stdev([100.0, 50.0]))


def test_rolling(series):
    df = series(a=[1.0, 2.0, 6.0, None, 3.0, 3.0, 9.0], b=[1.0, 2.0])
    mean = S.rolling_mean(df, K).collect()
    assert sorted((r["period"], r["value"]) for r in mean if r["id"] == "a") == [("2023-03", 3.0), ("2023-07", 5.0)]
    assert [(r["period"], r["insufficient_data"]) for r in mean if r["id"] == "b"] == [(None, True)]
    std = [r for r in S.rolling_std(df, K).collect() if r["id"] == "a"]
    assert math.isclose(min(std, key=lambda r: r["period"])["value"], statistics.stdev([1, 2, 6]))


def test_seasonality(series, spark):
    wave = [float(10 + i % 12) for i in range(24)]
    s = by(S.seasonality_signal(series(wave=wave, flat=[5.0] * 24, short=wave[:23], zero=[0.0] * 24), K))
    expected = statistics.pstdev(range(10, 22)) / statistics.mean(wave)
    assert math.isclose(s["wave"]["seasonal_strength"], expected)
    assert (s["wave"]["peak_month"], s["wave"]["trough_month"]) == (12, 1)
    assert (s["flat"]["seasonal_strength"], s["flat"]["peak_month"]) == (0.0, 1)
    assert s["short"]["insufficient_data"] and s["zero"]["insufficient_data"]
    odd = spark.createDataFrame([("x", f"2024-{i}", 1.0) for i in range(30)], "id string, period string, value double")
    assert S.seasonality_signal(odd, K).first()["insufficient_data"]


def test_extremum_takes_the_earliest(series):
    df = series(a=[2.0, 9.0, 1.0, 9.0, 1.0, None])
    assert S.period_extremum(df, "max", K).first()["period"] == "2023-02"
    assert S.period_extremum(df, "min", K).first()["period"] == "2023-03"
    with pytest.raises(ValueError):
        S.period_extremum(df, "mean", K)


def test_years(series):
    df = series(a=[1.0] * 14)
    assert by(S.year_totals(df, K), "year")["2024"]["value"] == 2.0
    assert S.year_slice(df, 2023).count() == 12


def test_anomalies(series):
    base = [10.0, 11.0, 9.0, 10.0, 12.0]
    df = series(high=[*base, 90.0], low=[-90.0, *base], both=[-90.0, *base, 90.0], flat=[5.0] * 5, few=[1.0, 2.0, 99.0], gap=[None, *base, 90.0])
    found = {(r["id"], r["position"], r["direction"]) for r in anomaly.iqr_anomalies(df, K).collect()}
    assert found == {("high", 5, "high"), ("low", 0, "low"), ("both", 0, "low"), ("both", 6, "high"), ("gap", 6, "high")}
    s = by(anomaly.iqr_summary(df, K, with_points=True))
    assert s["few"]["insufficient_data"] and s["few"]["sample_size"] == 3 and s["few"]["lower_bound"] is None
    assert s["flat"]["anomaly_count"] == 0 and len(s["both"]["anomalies"]) == 2


def test_investigation(spark):
    rows = [("sales", f"2024-{m:02d}", v) for m, v in zip(range(1, 7), [10.0, 11.0, 9.0, 10.0, 10.0, 80.0], strict=True)]
    rows += [("cost", f"2024-{m:02d}", v) for m, v in zip(range(1, 7), [1.0, 1.0, 1.0, 1.0, 1.0, 4.0], strict=True)]
    rows += [("late", "2024-06", 5.0)]
    df = spark.createDataFrame(rows, "column string, period string, value double")
    found = anomaly.iqr_anomalies(df, ["column"]).where(F.col("column") == "sales")
    r = anomaly.investigate_anomalies(found, df).first()
    assert r["own_change"]["absolute_change"] == 70.0
    others = {c["column"]: c for c in r["coincident_changes"]}
    assert others["cost"]["percentage_change"] == 300.0
    assert others["late"]["reason"] == "no_previous_period" and others["late"]["previous"] is None


def test_naive_forecast(series):
    df = series(a=[10.0, 12.0, 11.0], last=[1.0, None], two=[1.0, 2.0])
    f = [r for r in forecast.naive_forecast(df, K, 2).collect()]
    a = sorted((r for r in f if r["id"] == "a"), key=lambda r: r["period"])
    assert [r["period"] for r in a] == ["2023-04", "2023-05"]
    margin = 1.96 * statistics.stdev([2.0, -1.0])
    assert math.isclose(a[0]["upper_bound"], 11.0 + margin) and a[0]["is_forecast"]
    assert [r["insufficient_data"] for r in f if r["id"] == "last"] == [True]
    assert [r["bounds_available"] for r in f if r["id"] == "two"] == [False, False]
    assert forecast.naive_forecast(df, K, 0).where(~F.col("insufficient_data")).count() == 0


def test_seasonal_forecast(series):
    values = [float(i) for i in range(14)]
    gappy = [*values[:3], None, *values[4:]]
    df = series(a=values, gap=gappy, short=values[:11], hollow=[None] * 12)
    rows = forecast.seasonal_naive_forecast(df, K, 3).collect()
    got = {k: [(r["period"], r["forecast"]) for r in sorted(rows, key=lambda r: r["period"] or "") if r["id"] == k] for k in ("a", "gap")}
    assert got["a"] == [("2024-03", 2.0), ("2024-04", 3.0), ("2024-05", 4.0)]
    assert got["gap"] == [("2024-03", 2.0), ("2024-05", 4.0)]
    assert {r["id"] for r in rows if r["insufficient_data"]} == {"short", "hollow"}
    assert forecast.seasonal_naive_forecast(df.where("id = 'a'"), K, 40).count() == 12


def test_backtest(series):
    df = series(
        a=[10.0, 10.0, 12.0, 0.0, 8.0], short=[1.0, 2.0, 3.0], train=[None, 1.0, 2.0, 3.0, 4.0],
        held=[1.0, 2.0, 3.0, None, 4.0], zeros=[5.0, 0.0, 0.0, 0.0],
    )
    b = by(forecast.backtest_forecast(df, K))
    errors = [2.0, -10.0, -2.0]
    assert math.isclose(b["a"]["mae"], sum(map(abs, errors)) / 3)
    assert math.isclose(b["a"]["rmse"], math.sqrt(sum(e * e for e in errors) / 3))
    assert math.isclose(b["a"]["mape"], (2 / 12 + 2 / 8) / 2 * 100)
    assert b["zeros"]["mape"] is None and b["zeros"]["mae"] == 5.0
    assert {k: b[k]["reason"] for k in ("short", "train", "held")} == {
        "short": "insufficient_history", "train": "missing_values_in_training", "held": "missing_values_in_holdout",
    }
    assert forecast.backtest_forecast(df, K, "magic").first()["reason"] == "unsupported_method"
    assert forecast.backtest_forecast(df, K, holdout=0).first()["reason"] == "invalid_holdout"
    assert by(forecast.backtest_forecast(df, K, "seasonal_naive"))["a"]["reason"] == "insufficient_history"


def long_series(spark, seed=1):
    """Two thirds of the rows in one key, ties in value, missing values, zeros, and keys of one to five rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", None]) if i % 30 else f"k{i}"
        rows.append((key, f"{i:05d}", None if rng.random() < 0.05 else float(rng.choice([0, 1, rng.randint(-50, 50)]))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id string, period string, value double").repartition(5)


def same(a, b):
    assert a.columns == b.columns
    rows = [sorted(([None if v != v else round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()), key=str) for df in (a, b)]
    assert rows[0] == rows[1]


def test_long_series_give_the_same_as_short_ones(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 7)
    df = long_series(spark)
    for keys in ([], ["id"]):
        for f in (
            S.with_changes, S.comparison_counts, S.detect_trend, S.growth_rate, S.volatility,
            S.rolling_mean, S.rolling_std, anomaly.iqr_scores, anomaly.iqr_summary,
        ):
            same(f(df, keys), f(df, keys, long=True))
    same(S.rolling_mean(df, ["id"], 4), S.rolling_mean(df, ["id"], 4, long=True))
    months = spark.range(150).selectExpr("'h' as id", "date_format(add_months(date'1990-01-01', cast(id as int)), 'yyyy-MM') as period", "double(id * 7 % 40) as value")
    for keys in ([], ["id"]):
        same(forecast.naive_forecast(months, keys, 3), forecast.naive_forecast(months, keys, 3, long=True))
        same(forecast.seasonal_naive_forecast(months, keys, 5), forecast.seasonal_naive_forecast(months, keys, 5, long=True))
        for method in forecast.METHODS:
            same(forecast.backtest_forecast(months, keys, method), forecast.backtest_forecast(months, keys, method, long=True))


def test_long_series_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, period string, value double")
    for keys in ([], ["id"]):
        assert S.rolling_mean(empty, keys, long=True).count() == 0
        same(anomaly.iqr_summary(empty, keys), anomaly.iqr_summary(empty, keys, long=True))
        same(S.detect_trend(empty, keys), S.detect_trend(empty, keys, long=True))


def test_no_task_holds_a_long_series(spark):
    """Windows run over ranges and blocks, never over all rows."""
    df = spark.range(5000).selectExpr("id as period", "double(id % 17) as value")
    plan = S.rolling_mean(df, long=True)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__block" in line for line in windows)
    at = scan.placed(df.repartition(6), [], "period")
    assert at.where("__at <> period or __n <> 5000").count() == 0
    totals = scan.running_total(df, [], ["period"], "value").collect()
    run, want = 0.0, {}
    for i in range(5000):
        run += i % 17
        want[i] = run
    assert {r["period"]: r["__total"] for r in totals} == want


@pytest.mark.parametrize("long", [False, True])
def test_exact_quantiles(spark, long):
    rng = random.Random(4)
    values = [float(rng.randint(0, 500)) for _ in range(20_000)] + [rng.gauss(0, 1) * 10 ** rng.randint(-4, 6) for _ in range(20_001)] + [3.0] * 9000
    rows = [("hot", v) for v in values] + [("one", 1.5), ("two", 1.0), ("two", 4.0), ("none", None), (None, 2.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(6)
    parts = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], parts, long).collect()}
    assert set(got) == {"hot", "one", "two", None, "same"}
    for k, r in got.items():
        mine = [v for q, v in rows if q == k and v is not None]
        assert r["count"] == len(mine)
        assert r["quantiles"] == pytest.approx(np.percentile(mine, [100 * p for p in parts]).tolist(), rel=1e-12), k
    whole = exact_quantiles(df, [], [0.25, 0.75], long).first()
    everything = [v for _, v in rows if v is not None]
    assert whole["quantiles"] == pytest.approx(np.percentile(everything, [25, 75]).tolist(), rel=1e-12)
