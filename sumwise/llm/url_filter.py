"""URL filter: rules for hosts and paths, and a weighted vocabulary found by Aho-Corasick.

One automaton holds the strict and the soft terms.  It reads each URL once, whatever the size
of the vocabulary.  A hit counts only with a boundary on both sides: the neighbouring
character is no ASCII letter or digit.  One strict term rejects; soft terms reject when
enough different ones are found.  A rule that fits decides before the vocabulary.

Edge cases: a null URL and one without `://` have an empty host and path, so no rule fits;
the vocabulary still reads what text there is.  A path is empty where the URL ends after the
host; a rule's path is a plain prefix.  Of rules that fit, the longest host and path together
wins, then the longer host.  Repeated rows are judged each, an empty table gives an empty
result, further columns are ignored.  URLs are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwise.llm.common import ascii_lower

STRICT = (
    "adult", "bestiality", "casino", "escort", "hentai", "jackpot", "malware", "nude", "phishing",
    "porn", "porno", "viagra", "warez", "xxx",
)
SOFT = (
    "ads", "bet", "bonus", "cheap", "click", "coupon", "cracked", "dating", "download", "free", "hot",
    "loan", "lottery", "poker", "prize", "sex", "spam", "torrent", "win",
)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to `/`, `?`, `#` or the end, the path up to `?`, `#` or the end."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the rule that decides, null where none fits.  `rules` is a short list."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def term_hits(strict: Sequence[str], soft: Sequence[str]):
    """Column function: text to the numbers of different strict and soft terms in it."""
    weight = {**dict.fromkeys(soft, 0), **dict.fromkeys(strict, 1)}

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, kind in weight.items():
            automaton.add_word(term, (len(term), kind, term))
        automaton.make_automaton()

        def bounded(text: str, at: int) -> bool:
            return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())

        for series in texts:
            found = []
            for text in series:
                terms = (set(), set())
                for end, (n, kind, term) in automaton.iter(text or ""):
                    if bounded(text, end - n) and bounded(text, end + 1):
                        terms[kind].add(term)
                found.append((len(terms[1]), len(terms[0])))
            yield pd.DataFrame(found, columns=["strict_hits", "soft_hits"])

    return hits


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[Rule],
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    enough_soft: int = 2,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """`id`, host, path, rule, verdict, strict_hits, soft_hits of every row."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url")).select(
        "id", host.alias("host"), path.alias("path"), term_hits(strict, soft)(ascii_lower("url")).alias("hits")
    )
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    bad = (F.col("hits.strict_hits") > 0) | (F.col("hits.soft_hits") >= enough_soft)
    return parts.select(
        F.col("id").alias(id),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(said, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "hits.strict_hits",
        "hits.soft_hits",
    )
