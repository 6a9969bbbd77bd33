"""Pairs of alike texts of two tables, by a positional prefix filter over character bigrams.

Two texts of lengths a and b are alike if M matching characters in common blocks make
2 M / (a + b) >= 0.8.  From that follows, with s = a + b and M >= need = ceil(2 s / 5):

* between two blocks at least one character of either text is not matched, so there are at most
  s - 2 M + 1 blocks, and at least `shared` = 3 need - s - 1 bigrams lie within blocks;
* a matched bigram stands at most `shift` = max(a, b) - need places apart in the two texts;
* if each text's bigrams are put in any one order, the first matched one is among the first
  (number of bigrams - shared + 1) of both.

So only these prefixes are joined, rarer bigrams first.  `shared` is below 1 only for lengths 2
and 3, where a match needs the first of two characters among the first two of three: both count
as a token of their own.  Equal texts need no index and may or may not be found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import bound, join_on

SIMILAR = 0.8
COMMON = 256  # bigrams whose frequency orders the prefixes


@F.pandas_udf(T.DoubleType())
def _similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of name and hint; each distinct pair of a batch is compared once."""
    for names, hints in batches:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(names, hints, strict=True):
            if pair not in known:
                known[pair] = _ratio(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="float64")


def _ratio(name: str, hint: str) -> float:
    matcher = SequenceMatcher(None, name, hint)
    if matcher.real_quick_ratio() < SIMILAR or matcher.quick_ratio() < SIMILAR:
        return 0.0
    return matcher.ratio()


def _need(a: Column, b: Column) -> Column:
    return F.floor((2 * (a + b) + 4) / 5).cast("int")


def _shared(a: Column, b: Column) -> Column:
    return 3 * _need(a, b) - (a + b) - 1


def _bigrams(text: Column) -> Column:
    """Every bigram with its place, from 1."""
    places = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.substring(text, i, F.lit(2)).alias("gram"), i.alias("at")))


def _common_bigrams(texts: DataFrame) -> DataFrame:
    """One row: how often the most frequent bigrams occur."""
    counts = texts.select(F.explode(_bigrams(F.col("text"))).alias("g")).groupBy("g.gram").agg(F.count(F.lit(1)).alias("n"))
    most = counts.orderBy(F.desc("n"), "gram").limit(COMMON)
    return most.agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("often"))


def _tokens(texts: DataFrame, keys: Sequence[str], common: DataFrame, side: str) -> DataFrame:
    """`keys, gram` and, named after the side, text, size, place and rank of the tokens that may be the first in common."""
    size = F.length("text")
    partners = F.sequence(F.ceil(size * 2 / 3).cast("int"), F.floor(size * 3 / 2).cast("int"))
    least = F.array_min(F.transform(partners, lambda b: F.greatest(_shared(size, b), F.lit(1))))
    # The map of frequent bigrams is one row of at most COMMON entries.
    placed = texts.select(*keys, "text").crossJoin(F.broadcast(common))
    ranked = F.array_sort(
        F.transform(
            _bigrams(F.col("text")),
            lambda g: F.struct(F.coalesce(F.try_element_at("often", g["gram"]), F.lit(0)).alias("n"), g["gram"].alias("gram"), g["at"].alias("at")),
        )
    )
    prefix = F.slice(ranked, F.lit(1), F.greatest(size - least, F.lit(0)))
    tokens = F.transform(prefix, lambda g, i: F.struct(g["gram"].alias("gram"), g["at"].alias("at"), (i + 1).alias("rank")))
    first = F.when(size == 2, F.sequence(F.lit(1), F.lit(1))).when(size == 3, F.sequence(F.lit(1), F.lit(2)))
    short = F.transform(first, lambda i: F.struct(F.concat(F.lit("\0"), F.substring("text", i, F.lit(1))).alias("gram"), i.alias("at"), F.lit(0).alias("rank")))
    both = F.concat(tokens, F.coalesce(short, F.array().cast("array<struct<gram: string, at: int, rank: int>>")))
    return placed.select(*keys, "text", size.alias("size"), F.explode(both).alias("g")).select(
        *keys, F.col("g.gram").alias("gram"), *[F.col(c).alias(f"{side}_{c.split('.')[-1]}") for c in ("text", "size", "g.at", "g.rank")]
    )


def _may_be_alike() -> Column:
    """Bounds from the lengths and the place and rank of a shared token."""
    a, b = F.col("a_size"), F.col("b_size")
    shared = F.greatest(_shared(a, b), F.lit(1))
    return (
        (_need(a, b) <= F.least(a, b))
        & (F.abs(F.col("a_at") - F.col("b_at")) <= F.greatest(a, b) - _need(a, b))
        & (F.col("a_rank") <= a - shared)
        & (F.col("b_rank") <= b - shared)
    )


def _enough_in_common(a: Column, b: Column) -> Column:
    """Bounds from all bigrams and all characters of both texts."""
    grams = [F.transform(_bigrams(c), lambda g: g["gram"]).alias(side) for side, c in (("a", a), ("b", b))]
    need = _need(F.length(a), F.length(b))

    def in_common(g: Column) -> Column:
        repeats = F.least(*[F.size(g[side]) - F.size(F.array_distinct(g[side])) for side in ("a", "b")])
        return F.size(F.array_intersect(g["a"], g["b"])) + repeats >= _shared(F.length(a), F.length(b))

    def kept(x: Column, y: Column) -> Column:
        return F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))

    return (F.least(kept(a, b), kept(b, a)) >= need) & bound(F.struct(*grams), in_common)


def candidate_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], shuffled: bool = False) -> DataFrame:
    """`keys, a_text, b_text`: every pair of different texts that may be alike, and few others.

    `left` and `right` have `keys, text`, each text once for its keys.
    """
    common = _common_bigrams(right)
    joined = join_on(_tokens(left, keys, common, "a"), _tokens(right, keys, common, "b"), [*keys, "gram"], "inner", shuffled)
    return joined.where(_may_be_alike()).select(*keys, "a_text", "b_text").distinct().where(_enough_in_common(F.col("a_text"), F.col("b_text")))


def alike_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], shuffled: bool = False) -> DataFrame:
    """`keys, a_text, b_text, score` of the pairs with a ratio of at least 0.8."""
    return candidate_pairs(left, right, keys, shuffled).withColumn("score", _similarity("b_text", "a_text")).where(F.col("score") >= SIMILAR)


def may_be_alike(a: Column, b: Column) -> Column:
    """Whether two texts of one row may be alike, by the bounds that cost least first; none that is alike fails."""
    need = _need(F.length(a), F.length(b))
    return (need <= F.least(F.length(a), F.length(b))) & _enough_in_common(a, b)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def similarities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The ratio of a hint and each of the names its row lists; NULL where there is no list."""
    for hints, lists in batches:
        out = [None if names is None else [_ratio(name, hint) for name in names] for hint, names in zip(hints, lists, strict=True)]
        yield pd.Series(out, dtype="object")
