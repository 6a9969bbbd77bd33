"""Near-duplicate groups against brute force."""

import random

import numpy as np
import pytest

from sumwise.llm import near_duplicates as nd
from sumwise.llm.components import components
from sumwise.llm.shingles import shingle_set


def plain_set(text):
    words = [w for w in _split((text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}


def _split(text):
    import re

    return re.split("[\\x20\\x09-\\x0D]+", text)


def brute(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(
        ((i, len(s), least.get(root(k)), i == least.get(root(k))) for k, (i, s) in enumerate(sets)), key=str
    )


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, label int")
    return sorted((tuple(r) for r in nd.near_duplicates(docs).collect()), key=str)


def test_borders_and_edges(spark):
    base = [f"w{i}" for i in range(44)]
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "Hello"), (5, "hELLO\n"), (6, "É a"), (7, "é a"), (8, "a b c d"), (9, "a b c d e"),
        (20, " ".join(base)), (21, " ".join(base).upper()), (22, " ".join([*base[:43], "x"])), (23, " ".join([*base[:20], "x", *base[21:]])),
        (24, " ".join([*base[:18], "x", *base[19:], "y y y y"])), (20, " ".join(base)), (30, "other text"), (30, "other text again"),
        (None, " ".join([*base, "tail"])), (None, "lonely one"), (40, "v " * 5000), (41, "v " * 5001),
    ]
    assert result(spark, rows) == brute(rows)


def test_random_edits_chains_and_common_passages(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(12):
        words = [f"f{family}_{rng.randrange(300)}" for _ in range(rng.choice([8, 30, 120]))]
        if family % 3 == 0:
            words = words[:40] + passage
        for _ in range(14):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(words)))
    rows += [(10**6 + i, " ".join([f"u{i}_{k}" for k in range(20 + i % 20)] + passage)) for i in range(60)]
    assert result(spark, rows) == brute(rows)


def test_filter_tells_rows_with_one_id_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, None), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.without_near_duplicates(docs).collect()), key=str) == sorted([(1, a), (2, b), (None, None)], key=str)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_every_place_fills_and_agreement_is_similarity():
    sets = [np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 2, 3, 40, 1000)]
    sketch = nd.sketches(sets)
    assert (sketch != nd.EMPTY).all()
    a, b = shingle_set(" ".join(map(str, range(1000)))), shingle_set(" ".join(map(str, range(125, 1125))))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = nd.sketches([a, b])
    assert abs((x == y).mean() - exact) < 0.1


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    pairs += [(300, i) for i in range(301, 330)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(n):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return min(seen)

    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: least(n) for n in near}
