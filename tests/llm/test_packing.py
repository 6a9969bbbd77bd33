"""Packing: every token once, no bin too full, and costs close to the least possible."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumwise.llm import packing as pk

SIZES = (4, 8, 16)


def check(lengths, found, capacities):
    bins = {}
    for n, (b, at, size) in zip(lengths, found):
        bins.setdefault(b, []).append((at, n, size))
    for parts in bins.values():
        parts.sort()
        end = 0
        for at, n, _ in parts:
            assert at == end
            end += n
        assert {p[2] for p in parts} == {min(c for c in capacities if c >= end)}
    return sum(parts[0][2] + pk.OVERHEAD for parts in bins.values())


def least_cost(lengths, capacities, overhead):
    """By all ways to part the pieces."""
    best = None

    def go(rest, bins):
        nonlocal best
        if not rest:
            cost = sum(min(c for c in capacities if c >= b) + overhead for b in bins)
            best = cost if best is None else min(best, cost)
            return
        n, rest = rest[0], rest[1:]
        for k, b in enumerate(bins):
            if b + n <= max(capacities):
                go(rest, [*bins[:k], b + n, *bins[k + 1 :]])
        go(rest, [*bins, n])

    go(tuple(lengths), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80))
def test_any_lengths(lengths):
    check(lengths, pk.pack(lengths, SIZES), SIZES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=7))
def test_close_to_the_least_cost(lengths):
    found = pk.pack(lengths, SIZES, 1)
    cost = sum(size + 1 for _, size in {(b, size) for b, _, size in found})
    assert cost <= 1.5 * least_cost(lengths, SIZES, 1)


def test_single_capacity_is_best_fit_decreasing():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 17) for _ in range(300)]
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(16 - n)
    assert len({b for b, _, _ in pk.pack(lengths, (16,))}) == len(bins)


def rows_of(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sequence string")
    return pk.packed(docs, **more).collect()


@pytest.mark.parametrize("tokens", [8 << 20, 200])
def test_documents(spark, monkeypatch, tokens):
    monkeypatch.setattr(pk, "GROUP_TOKENS", tokens)
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(0, 30)) for i in range(200)] + [(None, "x"), (7, "again"), (7, "again"), (500, None), (501, ""), (502, "y" * 1000)]
    got = rows_of(spark, rows, capacities=SIZES, overhead=1)
    empty = [r for r in got if r.n_tokens == 0]
    assert len(empty) == sum(not t for _, t in rows) and all(r.sequence is r.capacity is r.offset is None for r in empty)
    sizes = {}
    for key, group in itertools.groupby(sorted((r.sequence, r.offset, r.n_tokens, r.capacity) for r in got if r.n_tokens), key=lambda r: r[0]):
        end = 0
        for _, at, n, size in group:
            assert at == end
            end += n
            sizes[key] = (end, size)
    assert all(size == min(c for c in SIZES if c >= end) for end, size in sizes.values())
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    for i, t in rows:
        if i != 7:
            assert sum(n for _, n in whole[i]) == len((t or "").encode())
            assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(whole[i])))
    assert rows_of(spark, []) == []


def test_little_padding_on_given_documents(spark):
    got = pk.packed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    by = got.where("sequence is not null").groupBy("sequence").agg({"capacity": "max", "n_tokens": "sum"}).collect()
    filled, room = sum(r["sum(n_tokens)"] for r in by), sum(r["max(capacity)"] for r in by)
    print("filled", filled / room)
    assert filled / room > 0.98
