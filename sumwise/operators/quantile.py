"""Exact medians and quantiles of columns of any size, by one way at every size.

1. A sketch per group, made in an aggregation that combines before the shuffle, brackets the
   wanted rank: of all values at most a `BRACKET` part lies between its two values.
2. The values are read once more.  Those below the bracket are only counted, those above it
   are dropped, and the few inside are counted by value, all before the shuffle.
3. The rank is read off the counts of the group, in the order of the values.

One task sees one sketch, or the distinct values inside one bracket: 0.1 % of a group at most.
Several quantiles share both scans, each with a bracket of its own; for one `long` group the
ranks are read off by a running total over ranges of values, so no task sees a whole bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import by_keys, join_on
from sumwise.operators.scan import running_total

ACCURACY = 10_000
MARGIN = 4.0 / ACCURACY  # four times what the sketch may be off
BRACKET = 2 * MARGIN + 2.0 / ACCURACY
SALTS = 64


def near_median(value: Column | str) -> Column:
    """Aggregate: two values that enclose the median, closely in a large group."""
    return F.percentile_approx(value, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)


def _beside(present: DataFrame, near: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """`present` values with the brackets of their group.

    `few` says that `near` has one row for each column of a schema at most, so it is broadcast.  Else a
    group is dealt to SALTS tasks, as a single one would sort all of its values for the join.
    """
    if not keys:
        return present.crossJoin(F.broadcast(near))
    if few:
        return join_on(present, F.broadcast(near), keys, "inner")
    dealt = present.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    copies = near.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(dealt, copies, [*keys, "__salt"], "inner").drop("__salt")


def exact_medians(values: DataFrame, keys: Sequence[str], near: DataFrame | None = None, few: bool = False) -> DataFrame:
    """`keys, median` over the non-null `value` column of `values`.

    `near` has `keys, count, near` (`near_median`) where an aggregation over the same values
    has made them already; `few` where the groups are the columns of one table.
    """
    keys = list(keys)
    present = values.where(F.col("value").isNotNull()).select(*keys, "value")
    if near is None:
        near = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), near_median("value").alias("near"))
    near = near.where(F.col("count") > 0).select(*keys, F.col("count").alias("__n"), F.col("near").alias("__near"))
    placed = _beside(present, near, keys, few)
    inside = placed.where(F.col("value") <= F.col("__near")[1])
    # Everything below the bracket is one entry without a value, which comes first.
    entry = F.when(F.col("value") >= F.col("__near")[0], F.col("value")).alias("value")
    counted = inside.select(*keys, "__n", entry).groupBy(*keys, "__n", "value").agg(F.count(F.lit(1)).alias("__rows"))
    last = F.sum("__rows").over(by_keys(keys, F.col("value").asc_nulls_first())) - 1
    ranked = counted.select(
        *keys,
        "value",
        last.alias("__last"),
        (last - F.col("__rows") + 1).alias("__first"),
        F.floor((F.col("__n") - 1) / 2).alias("__r1"),
        F.floor(F.col("__n") / 2).alias("__r2"),
    )

    def at(rank: str) -> Column:
        holds = (F.col("__first") <= F.col(rank)) & (F.col(rank) <= F.col("__last"))
        return F.max(F.when(holds, F.col("value")))

    return ranked.groupBy(*keys).agg(((at("__r1") + at("__r2")) / 2).alias("median"))


def exact_quantiles(values: DataFrame, keys: Sequence[str], parts: Sequence[float], long: bool = False) -> DataFrame:
    """`keys, count, quantiles` over the non-null `value` column of `values`, interpolated linearly."""
    keys = list(keys)
    present = values.where(F.col("value").isNotNull()).select(*keys, "value")
    edges = [p for part in parts for p in (max(0.0, part - MARGIN), min(1.0, part + MARGIN))]
    near = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("value", edges, ACCURACY).alias("__near"))
    near = near.where(F.col("__n") > 0)
    placed = _beside(present, near, keys)
    value = F.col("value")
    brackets = [(F.col("__near")[2 * k], F.col("__near")[2 * k + 1]) for k in range(len(parts))]
    inside = F.lit(False)
    for low, high in brackets:
        inside = inside | ((value >= low) & (value <= high))
    passed = F.array_max(F.array(*[F.when(value > high, high) for _, high in brackets]))
    # A value outside all brackets only counts, as an entry right after the last bracket below it.
    entry = [F.when(inside, value).otherwise(passed).alias("value"), (~inside).alias("__gap")]
    counted = placed.select(*keys, "__n", *entry).groupBy(*keys, "__n", "value", "__gap").agg(F.count(F.lit(1)).alias("__rows"))
    order = [F.col("value").asc_nulls_first(), F.col("__gap").asc()]
    if long:
        ranked = running_total(counted, keys, order, "__rows")
    else:
        ranked = counted.withColumn("__total", F.sum("__rows").over(by_keys(keys, *order)))
    last = F.col("__total") - 1
    first = F.col("__total") - F.col("__rows")

    def at(rank: Column) -> Column:
        return F.max(F.when(~F.col("__gap") & (first <= rank) & (rank <= last), value))

    found = []
    for part in parts:
        place = (F.col("__n") - 1) * F.lit(part)
        found += [at(F.floor(place)), at(F.ceil(place))]
    wide = ranked.groupBy(*keys, "__n").agg(*[f.alias(f"__q{k}") for k, f in enumerate(found)])
    quantiles = []
    for k, part in enumerate(parts):
        place = (F.col("__n") - 1) * F.lit(part)
        low, high, off = F.col(f"__q{2 * k}"), F.col(f"__q{2 * k + 1}"), place - F.floor(place)
        quantiles.append(F.when(off == 0, low).otherwise((1 - off) * low + off * high))
    return wide.select(*keys, F.col("__n").alias("count"), F.array(*quantiles).alias("quantiles"))
