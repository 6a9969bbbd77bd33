"""Monthly series and what follows from them: changes, trend, rolling, seasonality.

A series table has the key columns, `period` (`YYYY-MM`) and `value`, one row per
observed month.  The month aggregation is the only step that sees raw rows and it
combines before the shuffle; every window after it runs on the months of one series, so
its partitions are bounded by the length of the calendar, not by the data.  Series that are
not made of months can be of any length: `long` cuts them to ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import NUMBERS, by_keys, number_of
from sumwise.functions.change import change
from sumwise.functions.periods import STRICT_LABEL, month_label, month_of_label
from sumwise.functions.text import parse_timestamp, read_cells
from sumwise.operators.scan import steps

SERIES_TYPES = {"column": "string", "period": "string", "value": "double"}
ROLLING_WINDOW = 3
MIN_GROWTH_RATES = 2
MIN_SEASONAL_MONTHS = 24


def period_date(df: DataFrame, period: str) -> Column:
    """Calendar day of a period column; numbers are nanoseconds since 1970."""
    kind = df.schema[period].dataType
    if isinstance(kind, T.StringType):
        return parse_timestamp(period).cast("date")
    if isinstance(kind, NUMBERS):
        days = F.floor(F.col(period).cast("double") / F.lit(86_400e9)).cast("int")
        return F.date_add(F.lit("1970-01-01").cast("date"), days)
    return F.col(period).cast("date")


def with_measures(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """`df` and the numbers of its measure columns; text cells are cleaned on the way."""
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    numbers = [F.col(f"__{n}.num") if n in texts else number_of(df, n) for n in names]
    return (read_cells(df, {n: f"__{n}" for n in texts}) if texts else df), numbers


def period_series(df: DataFrame, period: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The period and value columns as they are, without aggregation."""
    return df.select(*keys, F.col(period).alias("period"), F.col(value).alias("value"))


def monthly_series(
    df: DataFrame, period: str, values: str | Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Sum per calendar month of one or more measures: `keys, column, period, value`.

    Rows whose period cannot be read are left out; months without rows stay absent.  A
    month whose values are all missing sums to 0.  A key without any readable period has
    no rows here, and so no trend.  A text measure with a cell that cannot be read is no
    measure for that key: it has no rows here, and `unreadable_measures` says why.
    """
    names = [values] if isinstance(values, str) else list(values)
    months = _month_sums(df, period, names, keys)
    unread = F.sum("unread").over(by_keys([*keys, "column"]))
    texts = any(isinstance(df.schema[n].dataType, T.StringType) for n in names)
    if texts:
        months = months.withColumn("__unread", unread).where(F.col("__unread") == 0)
    return months.where(F.col("__month").isNotNull()).select(
        *keys, "column", month_label("__month").alias("period"), "value"
    )


def unreadable_measures(
    df: DataFrame, period: str, values: str | Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """`keys, column, reason, cells` of the measures that have no series because of cells nobody can read."""
    names = [values] if isinstance(values, str) else list(values)
    cells = _month_sums(df, period, names, keys).groupBy(*keys, "column").agg(F.sum("unread").alias("cells"))
    return cells.where(F.col("cells") > 0).select(*keys, "column", F.lit("unreadable_values").alias("reason"), "cells")


def _month_sums(df: DataFrame, period: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`keys, column, __month, value, unread`: sums and unreadable cells; the month is NULL without a period."""
    month = F.trunc(period_date(df, period), "MM").alias("__month")
    read, numbers = with_measures(df.select(*{*keys, *names}, month), names)
    texts = [isinstance(df.schema[n].dataType, T.StringType) for n in names]
    unread = [F.col(f"__{n}.text").isNotNull().cast("long") if t else F.lit(0) for n, t in zip(names, texts)]
    rows = read.select(
        *keys,
        "__month",
        *[v.alias(f"__v{i}") for i, v in enumerate(numbers)],
        *[u.alias(f"__u{i}") for i, u in enumerate(unread)],
    )
    if not any(texts):
        rows = rows.where(F.col("__month").isNotNull())
    measures = [
        F.struct(
            F.lit(n).alias("column"),
            F.coalesce(F.sum(f"__v{i}"), F.lit(0.0)).alias("value"),
            F.sum(f"__u{i}").alias("unread"),
        ).alias(f"__m{i}")
        for i, n in enumerate(names)
    ]
    sums = rows.groupBy(*keys, "__month").agg(*measures)
    made = F.explode(F.array(*[f"__m{i}" for i in range(len(names))])).alias("m")
    return sums.select(*keys, "__month", made).select(*keys, "m.column", "__month", "m.value", "m.unread")


def with_changes(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """Every point with its change against the observed point before it.

    `from_period` is NULL on the first point of a series, `is_first` marks it, `n` is the
    length of the series.  `long` series are cut to ranges instead of one task for each.
    """
    points = series.select(*keys, order, "value")
    s = steps(points, keys, order, 1, long)
    previous = s.rows.select(
        *keys,
        F.lag(order).over(s.window).alias("from_period"),
        F.col(order).alias("to_period"),
        F.lag("value").over(s.window).alias("__previous"),
        F.col("value").alias("__current"),
        (s.position == 1).alias("is_first"),
        s.length.alias("n"),
        *s.marks,
    )
    c = s.own(previous).withColumn("__c", change("__previous", "__current"))
    return c.select(*keys, "from_period", "to_period", "is_first", "n", "__c.*")


def compare_periods(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """One row per consecutive pair of observed periods."""
    return with_changes(series, keys, order, long).where(~F.col("is_first")).drop("is_first", "n")


def comparison_counts(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """Per series: how many pairs are valid, invalid, and whether there are any."""
    pair = ~F.col("is_first")
    return (
        with_changes(series, keys, order, long)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("period_count"),
            F.count_if(pair & F.col("is_valid")).alias("valid_comparison_count"),
            F.count_if(pair & ~F.col("is_valid")).alias("invalid_comparison_count"),
            (F.count(F.lit(1)) < 2).alias("insufficient_data"),
        )
    )


def detect_trend(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """Per series: increasing, decreasing, stable, volatile or insufficient_data.

    Pairs from a zero base have a direction although they have no percentage.
    """
    pair = ~F.col("is_first")
    diff = F.when(pair, F.col("absolute_change"))
    counts = (
        with_changes(series, keys, order, long)
        .groupBy(*keys)
        .agg(
            F.count_if(pair & F.col("is_valid")).alias("valid_comparison_count"),
            F.count_if(pair & ~F.col("is_valid")).alias("invalid_comparison_count"),
            F.count(diff).alias("direction_comparison_count"),
            F.count_if(diff > 0).alias("increase_count"),
            F.count_if(diff < 0).alias("decrease_count"),
            F.count_if(diff == 0).alias("no_change_count"),
        )
    )
    total = F.col("direction_comparison_count")
    trend = (
        F.when(total == 0, "insufficient_data")
        .when(F.col("increase_count") == total, "increasing")
        .when(F.col("decrease_count") == total, "decreasing")
        .when(F.col("no_change_count") == total, "stable")
        .otherwise("volatile")
    )
    return counts.select(*keys, trend.alias("trend"), *[c for c in counts.columns if c not in keys])


def growth_rate(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """Percentage change into each period; NULL where the base is zero or missing."""
    return compare_periods(series, keys, order, long).select(
        *keys, F.col("to_period").alias("period"), F.col("percentage_change").alias("rate")
    )


def volatility(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """Sample standard deviation of the growth rates; needs two of them."""
    rate = F.when(~F.col("is_first"), F.col("percentage_change"))
    enough = F.count(rate) >= MIN_GROWTH_RATES
    return (
        with_changes(series, keys, order, long)
        .groupBy(*keys)
        .agg(
            F.when(enough, F.stddev_samp(rate)).alias("value"),
            (~enough).alias("insufficient_data"),
        )
    )


def _rolling(series: DataFrame, keys: Sequence[str], window: int, order: str, how, long: bool) -> DataFrame:
    s = steps(series.select(*keys, order, "value"), keys, order, window - 1, long)
    frame = s.window.rowsBetween(1 - window, 0)
    rolled = s.rows.select(
        *keys,
        F.col(order).alias("period"),
        F.count("value").over(frame).alias("__seen"),
        how("value").over(frame).alias("value"),
        s.position.alias("__row"),
        s.length.alias("__n"),
        *s.marks,
    )
    short = F.col("__n") < window
    full = ~short & (F.col("__seen") == window)
    return s.own(rolled).where(full | (short & (F.col("__row") == 1))).select(
        *keys,
        F.when(~short, F.col("period")).alias("period"),
        F.when(~short, F.col("value")).alias("value"),
        short.alias("insufficient_data"),
    )


def rolling_mean(
    series: DataFrame, keys: Sequence[str] = (), window: int = ROLLING_WINDOW, order: str = "period", long: bool = False
) -> DataFrame:
    """Mean over the last `window` observed points; incomplete windows are left out.

    A series shorter than the window has one row with `insufficient_data`.
    """
    return _rolling(series, keys, window, order, F.avg, long)


def rolling_std(
    series: DataFrame, keys: Sequence[str] = (), window: int = ROLLING_WINDOW, order: str = "period", long: bool = False
) -> DataFrame:
    """As `rolling_mean`, with the sample standard deviation."""
    return _rolling(series, keys, window, order, F.stddev_samp, long)


def seasonality_signal(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of the calendar-month means relative to the overall mean, with peak and trough."""
    by_month = (
        series.withColumn("__m", month_of_label("period"))
        .groupBy(*keys, "__m")
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            F.sum("value").alias("__sum"),
            F.count("value").alias("__seen"),
            F.avg("value").alias("__mean"),
        )
    )
    month, mean = F.col("__m"), F.col("__mean")
    facts = by_month.groupBy(*keys).agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("__n"),
        F.count_if(month.isNull()).alias("__odd"),
        F.count(month).alias("__months"),
        F.try_divide(F.sum("__sum"), F.sum("__seen")).alias("__overall"),
        F.stddev_pop(mean).alias("__spread"),
        F.min(F.when(mean.isNotNull(), F.struct(-mean, month.alias("m"))))["m"].alias("__peak"),
        F.min(F.when(mean.isNotNull(), F.struct(mean, month.alias("m"))))["m"].alias("__trough"),
    )
    enough = (
        (F.col("__n") >= MIN_SEASONAL_MONTHS)
        & (F.col("__odd") == 0)
        & (F.col("__months") >= 2)
        & F.coalesce(F.col("__overall") != 0, F.lit(False))
    )
    return facts.select(
        *keys,
        (~enough).alias("insufficient_data"),
        F.when(enough, F.try_divide(F.col("__spread"), F.abs("__overall"))).alias("seasonal_strength"),
        F.when(enough, F.col("__peak")).alias("peak_month"),
        F.when(enough, F.col("__trough")).alias("trough_month"),
    )


def period_extremum(series: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """The lowest (`min`) or highest (`max`) point; the earliest of equal ones."""
    if metric not in ("min", "max"):
        raise ValueError("metric must be 'min' or 'max'")
    rank = F.col("value") if metric == "min" else -F.col("value")
    best = F.min(F.struct(rank.alias("rank"), F.col("period"), F.col("value")))
    return (
        series.where(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, F.lit(metric).alias("metric"), "b.period", "b.value")
    )


def year_slice(series: DataFrame, year: int | str) -> DataFrame:
    """The months of one calendar year."""
    year = str(year)
    return series.where(F.col("period").rlike(STRICT_LABEL) & F.col("period").startswith(f"{year}-"))


def year_totals(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of each calendar year's months."""
    return (
        series.where(F.col("period").rlike(STRICT_LABEL))
        .groupBy(*keys, F.substring("period", 1, 4).alias("year"))
        .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.count(F.lit(1)).alias("months"))
    )
