"""URL verdicts, each case against what the rules say by hand."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sumwise.llm.queries import RULES
from sumwise.llm.url_filter import SOFT, STRICT, url_verdicts

CASES = {
    "https://a.net/x": ("a.net", "/x", "net/", "block"),
    "https://A.Net": ("a.net", "", None, "allow"),
    "http://www.example.net/en/1?q=/de/#a": ("www.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
    "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "http://b.example.com/de/x": ("b.example.com", "/de/x", "example.com/de/", "block"),
    "http://b.example.com/de": ("b.example.com", "/de", None, "allow"),
    "x://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
    "x://org/fr/casino": ("org", "/fr/casino", "org/fr/", "allow"),
    "https://a.org/casino/1": ("a.org", "/casino/1", None, "block"),
    "https://a.org/casinos/1": ("a.org", "/casinos/1", None, "allow"),
    "https://a.org/?free=1&x=free": ("a.org", "/", None, "allow"),
    "https://a.org/?free=1&x=CHEAP": ("a.org", "/", None, "block"),
    "https://a.org/écasinoé": ("a.org", "/écasinoé", None, "block"),
    "no scheme/net/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "a://b.org/c://d.net/": ("b.org", "/c://d.net/", None, "allow"),
    "a://b.org/x\ny": ("b.org", "/x\ny", None, "allow"),
}


def verdicts(spark, urls):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, hits string")
    return sorted(url_verdicts(pages, RULES).collect())


def test_cases(spark):
    got = verdicts(spark, CASES)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(CASES.values())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_verdicts(pages, RULES).count() == 0


def test_null_id_and_repeated_rows(spark):
    pages = spark.createDataFrame([(None, "a://x.net/"), (1, "a://x.net/"), (1, "a://x.net/")], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in url_verdicts(pages, RULES).collect()) == [
        (0, "block"), (1, "block"), (1, "block"),
    ]


def test_vocabulary_against_patterns(spark):
    words = [*STRICT[:4], *SOFT[:5], "a", "-", "/", "1", "é", "frees"]

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(words), max_size=9).map("".join), min_size=30, max_size=60))
    def agree(urls):
        def count(terms, u):
            return sum(bool(re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", u)) for t in terms)

        got = verdicts(spark, urls)
        assert [(r.strict_hits, r.soft_hits) for r in got] == [(count(STRICT, u), count(SOFT, u)) for u in urls]

    agree()
