"""Divergence of sources against a plain version, and the packed counting against a dictionary."""

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from sumwise.llm import divergence as dv

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = WORD.findall(text.translate(LOW))
        groups[lang].add(source)
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def p(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        q = {t: p(whole[t], sum(whole.values())) for t in kept}
        mine = {s: {t: p(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        for s in sources:
            pairs = [(sum((mine[s][t] - mine[o][t]) ** 2 // (mine[s][t] + mine[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [((mine[s][t] - q[t]) ** 2 // (mine[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and mine[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def result(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    return sorted(tuple(r) for r in dv.source_divergence(docs, **more).collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = [rng.choice(["a", "Ab", "été", "b" * 8, "c" * 9, "D" * 16, "e" * 17, "ﬀ" * 7, "g" * 40, "漢字"]) + rng.choice(["", "x", "Y", "ß"]) for _ in range(60)]
    out = []
    for _ in range(n):
        mark = rng.choice([" ", "\n", "-", "1", "\x00", "_", "~"])
        out.append((mark.join(rng.choice(words[: rng.choice([8, 60])]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, ""]), rng.choice("stu")))
    return out


def test_against_brute_force(spark):
    rows = corpus(300, 1) + [("rare words only", "fr", "s"), (None, "fr", None), ("", "fr", "t"), ("...", "it", "s"), (None, None, None)]
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert result(spark, rows) == want
    assert result(spark, rows, block_rows=20) == want  # many blocks


def test_edges(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None, None)] * 12) == []  # one group: no pair, no term
    rows = [("same words", "en", s) for s in "ab" for _ in range(11)]
    assert result(spark, rows) == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    ties = [(f"{w} common", "en", "a") for w in ("zz", "yy", "ÿ", "xx") for _ in range(10)] + [("common", "en", "b")] * 40
    assert result(spark, ties) == brute(ties)


def test_long_texts_are_counted_in_pieces(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "Beta", "x" * 30, "y" * 500]) for _ in range(400)) + "z" * 5000
    rows = [(long, "en", "a"), (None, "en", "a"), ("alpha beta", "en", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1).fillna("")
    got = defaultdict(lambda: np.zeros(2, int))
    for r in dv.term_counts(docs, 2000).where("term <> ''").collect():
        got[r.source, r.term] += (r.n, r.docs)
    want = Counter(("a", w) for w in WORD.findall(long.translate(LOW))) + Counter([("b", "alpha"), ("b", "beta")])
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == 1 for v in got.values())


@pytest.mark.parametrize("width", [1, 2])
def test_radix_order_is_the_stable_order(width):
    rng = np.random.default_rng(width)
    words = [rng.choice(rng.integers(0, 2**64, 50, np.uint64), 3000) for _ in range(width)]
    assert (dv.radix_order(words) == np.lexsort(words[::-1])).all()
    assert len(dv.radix_order([np.zeros(0, np.uint64)])) == 0


def test_weights_of_huge_counts_are_exact():
    counts = np.array([0, 1, 5 * 10**9, 7 * 10**15])
    assert dv.weights(counts, 10**16 + 7).tolist() == [1 + 10**9 * (int(c) + 2) // (10**16 + 7) for c in counts]
