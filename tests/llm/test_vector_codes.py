"""Codes of vectors against a plain version in Python."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from sumwise.llm import vector_codes as vc


def brute(rows, length=None):
    kept = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-longest // 16)
    cut = [(i, [math.floor(256 * x) for x in v] + [0] * (16 * width - len(v)), b) for i, v, b in kept]
    start = sorted(zip(cut, kept), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1][1]))[:64]
    books = [[tuple(v[k * width : (k + 1) * width]) for (_, v, _), _ in start] for k in range(16)]

    def near(k, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(books[k]))

    for _ in range(2):
        found = [[[] for _ in book] for book in books]
        for _, v, _ in cut:
            for k in range(16):
                part = tuple(v[k * width : (k + 1) * width])
                found[k][near(k, part)[1]].append(part)
        books = [
            [tuple(sum(c) // len(parts) for c in zip(*parts)) if parts else entry for entry, parts in zip(book, lists)] for book, lists in zip(books, found)
        ]
    out, sums = [], {}
    for i, v, b in cut:
        best = [near(k, tuple(v[k * width : (k + 1) * width])) for k in range(16)]
        error = sum(d for d, _ in best)
        sums[b] = sums.get(b, 0) + error
        out.append((i, "".join(f"{n:02x}" for _, n in best), error, b))
    whole = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[b], whole) for i, c, e, b in out), key=str)


def result(spark, rows):
    docs = spark.createDataFrame([(i, v, b, "x", 1) for i, v, b in rows], "vec_id long, embedding array<float>, label int, code string, id int")
    return sorted((tuple(r) for r in vc.vector_codes(docs.repartition(3)).collect()), key=str)


def vectors(n, length, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, length))
    return [[float(np.float32(x)) for x in centres[rng.integers(9)] + rng.normal(scale=0.2, size=length)] for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = [(i, v, i % 4 or None) for i, v in enumerate(vectors(700, 64, 1))]
    random.seed(1)
    rows += [(1000 + i, rows[i % 5][1], 7) for i in range(200)]  # copies: blocks of one point
    random.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    v = vectors(6, 20, 2)
    rows = [
        (1, v[0], 1), (2, None, 1), (3, [*v[1][:5], None], 1), (4, [*v[1][:5], math.nan], 1), (5, [*v[1][:5], math.inf], 1), (6, [-math.inf], None),
        (7, v[1], None), (7, v[2], None), (None, v[3], 3), (None, v[4], 3), (8, v[5], 3), (9, [], 3), (10, v[1][:3], 2), (11, v[0], 1),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None, 1)]) == []
    assert result(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])


def test_large_components(spark):
    rows = [(i, [x * 10_000 for x in v], 1) for i, v in enumerate(vectors(90, 32, 3))]
    assert result(spark, rows) == brute([(i, [float(np.float32(x)) for x in v], b) for i, v, b in rows])
    with pytest.raises(ValueError, match="too large"):
        result(spark, [(1, [1e30] * 16, 1)])


def test_many_labels_are_salted(spark):
    codes = spark.createDataFrame([(i, i % 3 or None, "c", i) for i in range(40)], "id long, label int, code string, error long")
    want = {(r.id, r.label_error) for r in vc.with_label_errors(codes).collect()}
    assert {(r.id, r.label_error) for r in vc.with_label_errors(codes, 1).collect()} == want and len(want) == 40


@pytest.mark.parametrize("axes, bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = vc.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(4)
    for width in (1, 4, 7):
        values = rng.integers(-30, 30, (300, width))
        values = values[vc.curve_order(values)]
        book = rng.integers(-30, 30, (64, width))
        low, high, sums = vc.boxes(values)
        apart = ((values[:, None] - book) ** 2).sum(axis=2)
        entries, distances = vc.nearest_entries(values, vc.shortlists(low, high, book), book, np.arange(len(low)))
        assert (entries == apart.argmin(axis=1)).all() and (distances == apart.min(axis=1)).all()
        count, total = vc.totals(values, low, high, sums, book)
        assert (count == np.bincount(entries, minlength=64)).all() and total.sum() == values.sum()
