"""Two baseline forecasts with honest bounds, and their backtest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import as_number
from sumwise.functions.periods import next_label
from sumwise.operators.scan import steps

METHODS = ("naive", "seasonal_naive")
SEASON = 12
HOLDOUT = 3
MIN_RESIDUALS = 2
CONFIDENCE_Z = 1.96


def _history(series: DataFrame, keys: Sequence[str], lag: int, long: bool) -> DataFrame:
    """Points with their position, series length and the residual at `lag`."""
    s = steps(series.select(*keys, "period", "value"), keys, "period", lag, long)
    value = as_number("value")
    points = s.rows.select(
        *keys,
        "period",
        value.alias("value"),
        s.position.alias("__pos"),
        s.length.alias("__n"),
        (value - F.lag(value, lag).over(s.window)).alias("__residual"),
        *s.marks,
    )
    return s.own(points)


def _entries(facts: DataFrame, keys: Sequence[str], method: str, steps: Column) -> DataFrame:
    """One row per forecast step, or one row with `insufficient_data` and nothing else."""
    bounded = F.col("__residuals") >= MIN_RESIDUALS
    margin = CONFIDENCE_Z * F.col("__spread")
    made = F.col("__s").isNotNull()
    value = F.col("__s.value")
    return facts.select("*", F.explode_outer(steps).alias("__s")).select(
        *keys,
        F.lit(method).alias("method"),
        (~made).alias("insufficient_data"),
        F.when(made, next_label("__last", F.col("__s.step"))).alias("period"),
        F.when(made, value).alias("forecast"),
        F.when(made, F.lit(True)).alias("is_forecast"),
        F.when(made, bounded).alias("bounds_available"),
        F.when(made & bounded, value - margin).alias("lower_bound"),
        F.when(made & bounded, value + margin).alias("upper_bound"),
    )


def naive_forecast(series: DataFrame, keys: Sequence[str] = (), periods_ahead: int = 1, long: bool = False) -> DataFrame:
    """Repeat the last value; nothing if the last value is missing."""
    facts = (
        _history(series, keys, 1, long)
        .groupBy(*keys)
        .agg(
            F.max("period").alias("__last"),
            F.max(F.when(F.col("__pos") == F.col("__n"), F.col("value"))).alias("__value"),
            F.count("__residual").alias("__residuals"),
            F.stddev_samp("__residual").alias("__spread"),
        )
    )
    ahead = F.sequence(F.lit(1), F.lit(max(periods_ahead, 1)))
    steps = F.when(
        F.col("__value").isNotNull() & F.lit(periods_ahead >= 1),
        F.transform(ahead, lambda h: F.struct(h.alias("step"), F.col("__value").alias("value"))),
    )
    return _entries(facts, keys, "naive", steps)


def seasonal_naive_forecast(
    series: DataFrame, keys: Sequence[str] = (), periods_ahead: int = 1, season_length: int = SEASON, long: bool = False
) -> DataFrame:
    """Repeat the value of one season ago, for at most one season.

    A missing anchor skips its own step only.
    """
    step = F.col("__pos") - (F.col("__n") - season_length)
    usable = (
        (F.col("__n") >= season_length) & (step >= 1) & (step <= periods_ahead) & F.col("value").isNotNull()
    )
    facts = (
        _history(series, keys, season_length, long)
        .groupBy(*keys)
        .agg(
            F.max("period").alias("__last"),
            F.array_sort(
                F.collect_list(F.when(usable, F.struct(step.alias("step"), F.col("value"))))
            ).alias("__steps"),
            F.count("__residual").alias("__residuals"),
            F.stddev_samp("__residual").alias("__spread"),
        )
    )
    return _entries(facts, keys, "seasonal_naive", F.col("__steps"))


def backtest_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    method: str = "naive",
    holdout: int = HOLDOUT,
    season_length: int = SEASON,
    long: bool = False,
) -> DataFrame:
    """Forecast the last `holdout` points from the rest: MAE, RMSE and MAPE, or a reason.

    Points and forecasts are matched by step, not by label.  MAPE covers the non-zero
    actual values only.
    """
    n, pos = F.col("__n"), F.col("__pos")
    s = steps(series.select(*keys, "period", "value"), keys, "period", max(season_length, holdout), long)
    value = as_number("value")
    # The value before the first held point is one step back from it, two from the next one.
    back = [F.when(s.position == s.length - holdout + k, F.lag(value, k).over(s.window)) for k in range(1, holdout + 1)]
    points = s.rows.select(
        *keys,
        value.alias("value"),
        s.position.alias("__pos"),
        s.length.alias("__n"),
        F.lag(value, season_length).over(s.window).alias("__season_ago"),
        F.coalesce(*back, F.lit(None).cast("double")).alias("__last_train"),
        *s.marks,
    )
    points = s.own(points)
    held = pos > n - holdout
    if method == "seasonal_naive":
        predicted = F.col("__season_ago")
        too_short = (n - holdout < season_length) | F.lit(holdout > season_length)
    else:
        predicted = F.col("__last_train")
        too_short = F.lit(False)
    error = F.when(held, F.col("value") - predicted)
    relative = F.when(F.col("value") != 0, F.abs(F.try_divide(error, F.col("value"))))
    facts = points.groupBy(*keys).agg(
        F.coalesce(F.first("__n"), F.lit(0)).alias("__n"),
        F.count_if(~held & F.col("value").isNull()).alias("__train_gaps"),
        F.count_if(held & F.col("value").isNull()).alias("__held_gaps"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(relative) * 100).alias("mape"),
    )
    reason = (
        F.when(F.lit(method not in METHODS), "unsupported_method")
        .when(F.lit(holdout < 1), "invalid_holdout")
        .when(n <= holdout, "insufficient_history")
        .when(F.col("__train_gaps") > 0, "missing_values_in_training")
        .when(too_short, "insufficient_history")
        .when(F.col("__held_gaps") > 0, "missing_values_in_holdout")
    )
    facts = facts.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return facts.select(
        *keys,
        F.lit(method).alias("method"),
        (~ok).alias("insufficient_data"),
        "reason",
        F.when(ok, F.lit(holdout)).alias("holdout"),
        *[F.when(ok, F.col(m)).alias(m) for m in ("mae", "rmse", "mape")],
    )
