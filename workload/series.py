"""Series, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumwise.operators import anomaly, forecast, series
from workload.inputs import rounded, table

PRIORITY = ["o_orderpriority", "column"]
CUSTOMER = ["o_custkey", "column"]
MEASURES = ["l_quantity", "l_extendedprice"]


def by_priority(spark, folder):
    return series.monthly_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])


def by_customer(spark, folder):
    return series.monthly_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_custkey"])


def by_flag(spark, folder):
    return series.monthly_series(table(spark, folder, "lineitem"), "l_shipdate", MEASURES, ["l_returnflag"])


def whole_table(spark, folder):
    return series.monthly_series(table(spark, folder, "events"), "ts", "value")


def monthly(key: str) -> str:
    return (
        f"m AS (SELECT {key} AS k, strftime(o_orderdate, '%Y-%m') AS period, "
        f"coalesce(sum(o_totalprice), 0) AS value FROM orders GROUP BY 1, 2)"
    )


PAIRS = """p AS (SELECT k, lag(period) OVER w AS from_period, period AS to_period,
    lag(value) OVER w AS previous, value AS current,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY k) AS n
  FROM m WINDOW w AS (PARTITION BY k ORDER BY period)),
d AS (SELECT *, current - previous AS diff,
    CASE WHEN previous = 0 AND current = 0 THEN 0.0
         WHEN previous <> 0 THEN (current - previous) / previous * 100 END AS pct,
    pos > 1 AS is_pair FROM p)"""


def q_period_series(spark, folder):
    df = series.period_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"])
    return df.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def q_monthly_series(spark, folder):
    return rounded(by_priority(spark, folder), 2, "value")


def q_monthly_series_all(spark, folder):
    return rounded(whole_table(spark, folder), 2, "value")


def q_monthly_measures(spark, folder):
    return rounded(by_flag(spark, folder), 2, "value")


def q_monthly_text_period(spark, folder):
    o = table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise(F.lit("soon"))
    amount = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    cells = o.select("o_orderstatus", text.alias("day"), amount.alias("amount"))
    return rounded(series.monthly_series(cells, "day", "amount", ["o_orderstatus"]), 2, "value")


def q_compare_periods(spark, folder):
    df = series.compare_periods(by_priority(spark, folder), PRIORITY).drop("column")
    return rounded(rounded(df, 2, "previous", "current", "absolute_change"), 4, "percentage_change")


def q_comparison_counts(spark, folder):
    return series.comparison_counts(by_customer(spark, folder), CUSTOMER).drop("column")


def q_detect_trend(spark, folder):
    return series.detect_trend(by_priority(spark, folder), PRIORITY).drop("column")


def q_detect_trend_by_customer(spark, folder):
    return series.detect_trend(by_customer(spark, folder), CUSTOMER).drop("column")


def q_growth_rate(spark, folder):
    return rounded(series.growth_rate(by_customer(spark, folder), CUSTOMER).drop("column"), 4, "rate")


def q_volatility(spark, folder):
    return rounded(series.volatility(by_customer(spark, folder), CUSTOMER).drop("column"), 3, "value")


def q_rolling_mean(spark, folder):
    return rounded(series.rolling_mean(by_customer(spark, folder), CUSTOMER).drop("column"), 2, "value")


def q_rolling_std(spark, folder):
    return rounded(series.rolling_std(by_priority(spark, folder), PRIORITY, 4).drop("column"), 2, "value")


def q_seasonality_signal(spark, folder):
    df = series.seasonality_signal(by_priority(spark, folder), PRIORITY).drop("column")
    return rounded(df, 6, "seasonal_strength")


def q_period_extremum(spark, folder):
    points = by_customer(spark, folder)
    both = series.period_extremum(points, "min", CUSTOMER).unionByName(
        series.period_extremum(points, "max", CUSTOMER)
    )
    return rounded(both.drop("column"), 2, "value")


def q_year_totals(spark, folder):
    return rounded(series.year_totals(by_priority(spark, folder), PRIORITY).drop("column"), 2, "value")


def q_year_slice(spark, folder):
    return rounded(series.year_slice(by_priority(spark, folder), 1997).drop("column"), 2, "value")


def q_iqr_scores(spark, folder):
    df = anomaly.iqr_scores(by_priority(spark, folder), PRIORITY).drop("column")
    return rounded(rounded(df, 2, "value"), 6, "lower_bound", "upper_bound")


def q_iqr_anomalies(spark, folder):
    return rounded(anomaly.iqr_anomalies(by_customer(spark, folder), CUSTOMER).drop("column"), 2, "value")


def q_iqr_summary(spark, folder):
    df = anomaly.iqr_summary(by_customer(spark, folder), CUSTOMER).drop("column")
    return rounded(df, 6, "lower_bound", "upper_bound")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _lines(spark, folder, value):
    """All shipments as one long series, in the order of their orders."""
    lines = table(spark, folder, "lineitem")
    return lines.select(F.struct(*LINE).alias("period"), F.col(value).alias("value"))


def q_rolling_mean_long(spark, folder):
    df = series.rolling_mean(_lines(spark, folder, "l_quantity"), window=5, long=True)
    return rounded(df.select("period.l_orderkey", "period.l_linenumber", "value", "insufficient_data"), 6, "value")


def q_compare_periods_long(spark, folder):
    df = series.compare_periods(_lines(spark, folder, "l_quantity"), long=True)
    own = ["from_period.l_orderkey as from_order", "to_period.l_orderkey as to_order", "absolute_change", "percentage_change", "is_valid"]
    return rounded(df.selectExpr(*own), 6, "percentage_change")


def q_detect_trend_long(spark, folder):
    return series.detect_trend(_lines(spark, folder, "l_quantity"), long=True)


def q_iqr_scores_long(spark, folder):
    df = anomaly.iqr_scores(_lines(spark, folder, "l_extendedprice"), long=True)
    return rounded(df.drop("period"), 6, "lower_bound", "upper_bound")


def q_iqr_summary_long(spark, folder):
    """Quantities of every return flag, three groups that hold all rows."""
    points = table(spark, folder, "lineitem").select("l_returnflag", F.struct(*LINE).alias("period"), F.col("l_extendedprice").alias("value"))
    return rounded(anomaly.iqr_summary(points, ["l_returnflag"], long=True), 6, "lower_bound", "upper_bound")


def q_investigate_anomalies(spark, folder):
    points = by_flag(spark, folder)
    found = anomaly.iqr_anomalies(points, ["l_returnflag", "column"])
    df = anomaly.investigate_anomalies(found, points, ["l_returnflag"])
    return df.select(
        "l_returnflag",
        "column",
        "period",
        F.round("value", 2).alias("value"),
        "direction",
        F.round("own_change.absolute_change", 2).alias("own_change"),
        F.col("own_change.reason").alias("own_reason"),
        F.size("coincident_changes").alias("others"),
        F.round(F.col("coincident_changes")[0]["absolute_change"], 2).alias("other_change"),
    )


def q_naive_forecast(spark, folder):
    df = forecast.naive_forecast(by_customer(spark, folder), CUSTOMER, 2).drop("column")
    return rounded(df, 2, "forecast", "lower_bound", "upper_bound")


def q_seasonal_naive_forecast(spark, folder):
    df = forecast.seasonal_naive_forecast(by_priority(spark, folder), PRIORITY, 6).drop("column")
    return rounded(df, 2, "forecast", "lower_bound", "upper_bound")


def q_backtest_naive(spark, folder):
    df = forecast.backtest_forecast(by_customer(spark, folder), CUSTOMER, "naive").drop("column")
    return rounded(df, 2, "mae", "rmse", "mape")


def q_backtest_seasonal_naive(spark, folder):
    df = forecast.backtest_forecast(by_priority(spark, folder), PRIORITY, "seasonal_naive").drop("column")
    return rounded(df, 2, "mae", "rmse", "mape")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_TREND = """SELECT k AS {key},
  CASE WHEN count(diff) = 0 THEN 'insufficient_data'
       WHEN count(diff) FILTER (diff > 0) = count(diff) THEN 'increasing'
       WHEN count(diff) FILTER (diff < 0) = count(diff) THEN 'decreasing'
       WHEN count(diff) FILTER (diff = 0) = count(diff) THEN 'stable' ELSE 'volatile' END AS trend,
  count(*) FILTER (is_pair AND pct IS NOT NULL) AS valid_comparison_count,
  count(*) FILTER (is_pair AND pct IS NULL) AS invalid_comparison_count,
  count(diff) AS direction_comparison_count,
  count(*) FILTER (diff > 0) AS increase_count, count(*) FILTER (diff < 0) AS decrease_count,
  count(*) FILTER (diff = 0) AS no_change_count FROM d GROUP BY k"""

_BOUNDS = """b AS (SELECT k, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM m GROUP BY k),
s AS (SELECT m.k, period, value, row_number() OVER (PARTITION BY m.k ORDER BY period) - 1 AS position, n,
  CASE WHEN n >= 4 THEN q1 - 1.5 * (q3 - q1) END AS lo, CASE WHEN n >= 4 THEN q3 + 1.5 * (q3 - q1) END AS hi
  FROM m JOIN b ON m.k = b.k),
t AS (SELECT *, CASE WHEN value > hi THEN 'high' WHEN value < lo THEN 'low' END AS direction FROM s)"""

_BACKTEST = """h AS (SELECT k, value, row_number() OVER w AS pos, count(*) OVER (PARTITION BY k) AS n,
    lag(value, 12) OVER w AS season FROM m WINDOW w AS (PARTITION BY k ORDER BY period)),
l AS (SELECT *, max(CASE WHEN pos = n - 3 THEN value END) OVER (PARTITION BY k) AS last_train FROM h),
e AS (SELECT k, n, value, value - {anchor} AS err FROM l WHERE pos > n - 3),
a AS (SELECT k, any_value(n) AS n, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse,
    avg(CASE WHEN value <> 0 THEN abs(err / value) END) * 100 AS mape FROM e GROUP BY k)
SELECT k AS {key}, '{method}' AS method, n < {need} AS insufficient_data,
  CASE WHEN n < {need} THEN 'insufficient_history' END AS reason,
  CASE WHEN n >= {need} THEN 3 END AS holdout,
  CASE WHEN n >= {need} THEN round(mae, 2) END AS mae, CASE WHEN n >= {need} THEN round(rmse, 2) END AS rmse,
  CASE WHEN n >= {need} THEN round(mape, 2) END AS mape FROM a"""

_P, _C = monthly("o_orderpriority"), monthly("o_custkey")

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_IQR = "quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3"

SQL = {
    "rolling_mean_long": f"""SELECT l_orderkey, l_linenumber, round(value, 6) AS value, false AS insufficient_data FROM (
        SELECT l_orderkey, l_linenumber, avg(l_quantity) OVER (ORDER BY {_LINE} ROWS 4 PRECEDING) AS value, row_number() OVER (ORDER BY {_LINE}) AS rn
        FROM lineitem) WHERE rn >= 5""",
    "compare_periods_long": f"""WITH p AS (SELECT lag(l_orderkey) OVER w AS from_order, l_orderkey AS to_order, lag(l_quantity) OVER w AS a, l_quantity AS b
        FROM lineitem WINDOW w AS (ORDER BY {_LINE}))
      SELECT from_order, to_order, b - a AS absolute_change, round((b - a) / a * 100, 6) AS percentage_change, true AS is_valid
      FROM p WHERE from_order IS NOT NULL""",
    "detect_trend_long": f"""WITH p AS (SELECT l_quantity - lag(l_quantity) OVER (ORDER BY {_LINE}) AS d FROM lineitem)
      SELECT 'volatile' AS trend, count(d) AS valid_comparison_count, 0 AS invalid_comparison_count, count(d) AS direction_comparison_count,
        count(*) FILTER (d > 0) AS increase_count, count(*) FILTER (d < 0) AS decrease_count, count(*) FILTER (d = 0) AS no_change_count FROM p""",
    "iqr_scores_long": f"""WITH q AS (SELECT {_IQR}, count(*) AS n FROM lineitem)
      SELECT l_extendedprice AS value, row_number() OVER (ORDER BY {_LINE}) - 1 AS position, n AS sample_size, false AS insufficient_data,
        round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
        CASE WHEN l_extendedprice > q3 + 1.5 * (q3 - q1) THEN 'high' WHEN l_extendedprice < q1 - 1.5 * (q3 - q1) THEN 'low' END AS direction
      FROM lineitem, q""",
    "iqr_summary_long": f"""WITH q AS (SELECT l_returnflag, {_IQR}, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT l_returnflag, 'iqr' AS method, false AS insufficient_data, any_value(n) AS sample_size,
        round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_bound,
        count(*) FILTER (l_extendedprice > q3 + 1.5 * (q3 - q1) OR l_extendedprice < q1 - 1.5 * (q3 - q1)) AS anomaly_count
      FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""",
    "period_series": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS period, o_totalprice AS value FROM orders",
    "monthly_series": f"WITH {_P} SELECT k AS o_orderpriority, 'o_totalprice' AS \"column\", period, round(value, 2) AS value FROM m",
    "monthly_series_all": "SELECT 'value' AS \"column\", strftime(ts, '%Y-%m') AS period, round(sum(value), 2) AS value FROM events GROUP BY 2",
    "monthly_measures": """WITH a AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS period,
        sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
      SELECT l_returnflag, 'l_quantity' AS "column", period, round(q, 2) AS value FROM a
      UNION ALL SELECT l_returnflag, 'l_extendedprice', period, round(p, 2) FROM a""",
    "monthly_text_period": """SELECT o_orderstatus, 'amount' AS "column", strftime(o_orderdate, '%Y-%m') AS period,
        round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY 1, 3""",
    "compare_periods": f"""WITH {_P}, {PAIRS} SELECT k AS o_orderpriority, from_period, to_period,
        round(previous, 2) AS previous, round(current, 2) AS current, round(diff, 2) AS absolute_change,
        round(pct, 4) AS percentage_change, pct IS NOT NULL AS is_valid,
        CASE WHEN previous = 0 AND current <> 0 THEN 'division_by_zero' END AS reason FROM d WHERE is_pair""",
    "comparison_counts": f"""WITH {_C}, {PAIRS} SELECT k AS o_custkey, count(*) AS period_count,
        count(*) FILTER (is_pair AND pct IS NOT NULL) AS valid_comparison_count,
        count(*) FILTER (is_pair AND pct IS NULL) AS invalid_comparison_count,
        count(*) < 2 AS insufficient_data FROM d GROUP BY k""",
    "detect_trend": f"WITH {_P}, {PAIRS} {_TREND.format(key='o_orderpriority')}",
    "detect_trend_by_customer": f"WITH {_C}, {PAIRS} {_TREND.format(key='o_custkey')}",
    "growth_rate": f"WITH {_C}, {PAIRS} SELECT k AS o_custkey, to_period AS period, round(pct, 4) AS rate FROM d WHERE is_pair",
    "volatility": f"""WITH {_C}, {PAIRS} SELECT k AS o_custkey,
        CASE WHEN count(pct) >= 2 THEN round(stddev_samp(pct), 3) END AS value,
        count(pct) < 2 AS insufficient_data FROM d GROUP BY k""",
    "rolling_mean": f"""WITH {_C}, r AS (SELECT k, period, avg(value) OVER w AS v, row_number() OVER (PARTITION BY k ORDER BY period) AS pos,
          count(*) OVER (PARTITION BY k) AS n FROM m
          WINDOW w AS (PARTITION BY k ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
      SELECT k AS o_custkey, CASE WHEN n >= 3 THEN period END AS period, CASE WHEN n >= 3 THEN round(v, 2) END AS value,
        n < 3 AS insufficient_data FROM r WHERE (n >= 3 AND pos >= 3) OR (n < 3 AND pos = 1)""",
    "rolling_std": f"""WITH {_P}, r AS (SELECT k, period, stddev_samp(value) OVER w AS v, row_number() OVER (PARTITION BY k ORDER BY period) AS pos,
          count(*) OVER (PARTITION BY k) AS n FROM m
          WINDOW w AS (PARTITION BY k ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
      SELECT k AS o_orderpriority, CASE WHEN n >= 4 THEN period END AS period, CASE WHEN n >= 4 THEN round(v, 2) END AS value,
        n < 4 AS insufficient_data FROM r WHERE (n >= 4 AND pos >= 4) OR (n < 4 AND pos = 1)""",
    "seasonality_signal": f"""WITH {_P}, c AS (SELECT k, CAST(substr(period, 6, 2) AS INTEGER) AS mon, avg(value) AS v FROM m GROUP BY 1, 2),
        o AS (SELECT k, count(*) AS n, avg(value) AS mean FROM m GROUP BY k),
        f AS (SELECT k, stddev_pop(v) AS spread, count(*) AS months, arg_max(mon, (v, -mon)) AS peak, arg_min(mon, (v, mon)) AS trough FROM c GROUP BY k)
      SELECT f.k AS o_orderpriority, NOT (n >= 24 AND months >= 2 AND mean <> 0) AS insufficient_data,
        CASE WHEN n >= 24 AND months >= 2 AND mean <> 0 THEN round(spread / abs(mean), 6) END AS seasonal_strength,
        CASE WHEN n >= 24 AND months >= 2 AND mean <> 0 THEN peak END AS peak_month,
        CASE WHEN n >= 24 AND months >= 2 AND mean <> 0 THEN trough END AS trough_month
      FROM f JOIN o ON f.k = o.k""",
    "period_extremum": f"""WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value, period) AS lo,
          row_number() OVER (PARTITION BY k ORDER BY value DESC, period) AS hi FROM m)
      SELECT k AS o_custkey, 'min' AS metric, period, round(value, 2) AS value FROM r WHERE lo = 1
      UNION ALL SELECT k, 'max', period, round(value, 2) FROM r WHERE hi = 1""",
    "year_totals": f"""WITH {_P} SELECT k AS o_orderpriority, substr(period, 1, 4) AS year, round(sum(value), 2) AS value,
        count(*) AS months FROM m GROUP BY 1, 2""",
    "year_slice": f"WITH {_P} SELECT k AS o_orderpriority, period, round(value, 2) AS value FROM m WHERE period LIKE '1997-%'",
    "iqr_scores": f"""WITH {_P}, {_BOUNDS} SELECT k AS o_orderpriority, period, round(value, 2) AS value, position, n AS sample_size,
        n < 4 AS insufficient_data, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, direction FROM t""",
    "iqr_anomalies": f"""WITH {_C}, {_BOUNDS} SELECT k AS o_custkey, position, period, round(value, 2) AS value, direction
        FROM t WHERE direction IS NOT NULL""",
    "iqr_summary": f"""WITH {_C}, {_BOUNDS} SELECT k AS o_custkey, 'iqr' AS method, any_value(n) < 4 AS insufficient_data,
        any_value(n) AS sample_size, round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
        count(direction) AS anomaly_count FROM t GROUP BY k""",
    "investigate_anomalies": f"""WITH a AS (SELECT l_returnflag AS f, strftime(l_shipdate, '%Y-%m') AS period,
          sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
        m AS (SELECT (f, 'l_quantity') AS k, f, 'l_quantity' AS c, period, q AS value FROM a
          UNION ALL SELECT (f, 'l_extendedprice'), f, 'l_extendedprice', period, p FROM a),
        {_BOUNDS},
        g AS (SELECT k, f, c, period, value - lag(value) OVER w AS diff, row_number() OVER w AS pos FROM m
          WINDOW w AS (PARTITION BY k ORDER BY period))
      SELECT g.f AS l_returnflag, g.c AS "column", t.period, round(t.value, 2) AS value, t.direction,
        round(g.diff, 2) AS own_change, CASE WHEN g.pos = 1 THEN 'no_previous_period' END AS own_reason,
        1 AS others, round(o.diff, 2) AS other_change
      FROM t JOIN g ON t.k = g.k AND t.period = g.period
      JOIN g AS o ON o.f = g.f AND o.c <> g.c AND o.period = g.period
      WHERE t.direction IS NOT NULL""",
    "naive_forecast": f"""WITH {_C}, r AS (SELECT k, period, value, value - lag(value) OVER (PARTITION BY k ORDER BY period) AS diff FROM m),
        f AS (SELECT k, max(period) AS last, arg_max(value, period) AS v, count(diff) AS n, stddev_samp(diff) AS sd FROM r GROUP BY k),
        x AS (SELECT *, unnest([1, 2]) AS step FROM f)
      SELECT k AS o_custkey, 'naive' AS method, false AS insufficient_data,
        strftime(strptime(last || '-01', '%Y-%m-%d') + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period, round(v, 2) AS forecast,
        true AS is_forecast, n >= 2 AS bounds_available,
        CASE WHEN n >= 2 THEN round(v - 1.96 * sd, 2) END AS lower_bound,
        CASE WHEN n >= 2 THEN round(v + 1.96 * sd, 2) END AS upper_bound FROM x""",
    "seasonal_naive_forecast": f"""WITH {_P}, r AS (SELECT k, period, value, value - lag(value, 12) OVER w AS diff,
          row_number() OVER w AS pos, count(*) OVER (PARTITION BY k) AS n FROM m WINDOW w AS (PARTITION BY k ORDER BY period)),
        f AS (SELECT k, max(period) AS last, count(diff) AS c, stddev_samp(diff) AS sd, any_value(n) AS n FROM r GROUP BY k),
        x AS (SELECT f.*, r.value AS v, r.pos - (r.n - 12) AS step FROM f JOIN r ON f.k = r.k
          WHERE r.n >= 12 AND r.pos - (r.n - 12) BETWEEN 1 AND 6)
      SELECT k AS o_orderpriority, 'seasonal_naive' AS method, false AS insufficient_data,
        strftime(strptime(last || '-01', '%Y-%m-%d') + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period, round(v, 2) AS forecast,
        true AS is_forecast, c >= 2 AS bounds_available,
        CASE WHEN c >= 2 THEN round(v - 1.96 * sd, 2) END AS lower_bound,
        CASE WHEN c >= 2 THEN round(v + 1.96 * sd, 2) END AS upper_bound FROM x""",
    "backtest_naive": f"WITH {_C}, " + _BACKTEST.format(anchor="last_train", key="o_custkey", method="naive", need=4),
    "backtest_seasonal_naive": f"WITH {_P}, "
    + _BACKTEST.format(anchor="season", key="o_orderpriority", method="seasonal_naive", need=15),
}
