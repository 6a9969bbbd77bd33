"""Outliers of a series by the interquartile range, and what else moved with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import as_number, by_keys, join_on, stored
from sumwise.operators.quantile import exact_quantiles
from sumwise.operators.scan import placed
from sumwise.operators.series import with_changes

MIN_OBSERVATIONS = 4
IQR_FACTOR = 1.5


def iqr_scores(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """Every point with its 0-based position, the bounds of its series and its direction.

    Quartiles interpolate linearly.  With fewer than four values there are no bounds.  One
    shuffle by `keys` serves the quartiles and the positions of short series; `long` ones get
    their positions and quartiles by ranges, so that no task holds a whole series.
    """
    value = as_number("value")
    if long:
        points = series.select(*keys, F.col(order).alias("period"), value.alias("value"))
        found = placed(points, keys, "period")
        quartiles = stored(exact_quantiles(found, keys, [0.25, 0.75], long=True))
        # Without keys the quartiles are a single row.
        scored = join_on(found, quartiles, keys) if keys else found.join(F.broadcast(quartiles), how="left")
        size, q = F.coalesce("count", F.lit(0)).alias("sample_size"), F.col("quantiles").alias("__q")
        scored = scored.select(*keys, "period", "value", F.col("__at").alias("position"), size, q)
    else:
        w = by_keys(keys)
        scored = series.select(
            *keys,
            F.col(order).alias("period"),
            value.alias("value"),
            (F.row_number().over(by_keys(keys, order)) - 1).alias("position"),
            F.count(value).over(w).alias("sample_size"),
            F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(w).alias("__q"),
        )
    enough = F.col("sample_size") >= MIN_OBSERVATIONS
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    scored = scored.select(
        *[c for c in scored.columns if c != "__q"],
        (~enough).alias("insufficient_data"),
        F.when(enough, q1 - IQR_FACTOR * (q3 - q1)).alias("lower_bound"),
        F.when(enough, q3 + IQR_FACTOR * (q3 - q1)).alias("upper_bound"),
    )
    direction = F.when(F.col("value") > F.col("upper_bound"), "high").when(
        F.col("value") < F.col("lower_bound"), "low"
    )
    return scored.withColumn("direction", direction)


def iqr_anomalies(series: DataFrame, keys: Sequence[str] = (), order: str = "period", long: bool = False) -> DataFrame:
    """The points outside the bounds."""
    return (
        iqr_scores(series, keys, order, long)
        .where(F.col("direction").isNotNull())
        .select(*keys, "position", "period", "value", "direction")
    )


def iqr_summary(
    series: DataFrame, keys: Sequence[str] = (), order: str = "period", with_points: bool = False, long: bool = False
) -> DataFrame:
    """Per series: sample size, bounds and number of anomalies, on request with the points.

    The points of `long` series are better read from `iqr_anomalies`, as rows.
    """
    point = F.struct("position", "period", "value", "direction")
    extra = (
        [F.array_sort(F.collect_list(F.when(F.col("direction").isNotNull(), point))).alias("anomalies")]
        if with_points
        else []
    )
    return (
        iqr_scores(series, keys, order, long)
        .groupBy(*keys)
        .agg(
            F.lit("iqr").alias("method"),
            F.coalesce(F.first("insufficient_data"), F.lit(True)).alias("insufficient_data"),
            F.coalesce(F.first("sample_size"), F.lit(0)).alias("sample_size"),
            F.first("lower_bound").alias("lower_bound"),
            F.first("upper_bound").alias("upper_bound"),
            F.count("direction").alias("anomaly_count"),
            *extra,
        )
    )


def measure_changes(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change of every measure into every period; the first one has no previous period."""
    changes = with_changes(series, [*keys, "column"])
    first = F.col("is_first")
    return changes.select(
        *keys,
        "column",
        F.col("to_period").alias("period"),
        "previous",
        "current",
        "absolute_change",
        "percentage_change",
        (F.col("is_valid") & ~first).alias("is_valid"),
        F.when(first, "no_previous_period").otherwise(F.col("reason")).alias("reason"),
    )


def investigate_anomalies(
    anomalies: DataFrame, series: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Each anomaly with its own change and the changes of the other measures in that period.

    `anomalies` and `series` carry `keys` and `column`.  What moved at the same time is
    reported as a coincidence, never as a cause.
    """
    facts = ["column", "previous", "current", "absolute_change", "percentage_change", "is_valid", "reason"]
    moves = (
        measure_changes(series, keys)
        .groupBy(*keys, "period")
        .agg(F.array_sort(F.collect_list(F.struct(*facts))).alias("__moves"))
    )
    joined = join_on(anomalies, moves, [*keys, "period"])
    own = F.filter("__moves", lambda m: m["column"] == F.col("column"))
    others = F.filter("__moves", lambda m: m["column"] != F.col("column"))
    return joined.select(
        *keys,
        "column",
        "period",
        "value",
        "direction",
        F.try_element_at(own, F.lit(1)).alias("own_change"),
        F.coalesce(others, F.array()).alias("coincident_changes"),
    )
