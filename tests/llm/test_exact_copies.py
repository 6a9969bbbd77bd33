"""Exact copies against brute force, and the guarantee of the summaries."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from sumwise.llm import exact_copies as ec


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def docs_of(spark, rows, parts=7):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(parts)


def result(spark, rows, **more):
    return sorted((tuple(r) for r in ec.exact_copies(docs_of(spark, rows), **more).collect()), key=str)


ROWS = [
    (1, None), (2, ""), (3, "a"), (4, "A"), (5, "a "), (6, "a"), (7, "ä"), (8, "ä"), (9, "x" * 300_000), (10, "x" * 300_000),
    (11, "x" * 299_999 + "y"), (None, "null id"), (None, "null id"), (None, "a"), (12, "twice"), (12, "twice"), (12, "other"), (0, "\x00"), (-5, "\x00"),
]


def test_edges(spark):
    assert result(spark, ROWS) == brute(ROWS)
    assert result(spark, []) == []


def test_frequent_and_rare_texts_together(spark):
    random.seed(1)
    rows = [(i, "hot" if i % 3 == 0 else f"warm {i % 40}" if i % 3 == 1 else f"t{random.randrange(900)}") for i in range(3000)]
    random.shuffle(rows)
    for frequent in (4, 50, 5000):  # some, most and all groups are settled where they are read
        assert result(spark, rows, frequent=frequent) == brute(rows)


def test_summaries_find_every_frequent_digest(spark):
    random.seed(2)
    rows = [(i, f"h{i % 5}" if random.random() < 0.6 else f"t{i}") for i in range(4000)]
    docs = docs_of(spark, rows).select(F.col("doc_id").alias("id"), ec.digest_of(F.col("text")).alias("digest"))
    true = Counter(t for _, t in rows)
    for counters in (1, 3, 10, 40):
        found = {bytes(r.digest): r.n for r in ec.summaries(docs, counters).groupBy("digest").agg(F.sum("n").alias("n")).collect()}
        for text, n in true.items():
            got = found.get(hashlib.sha256(text.encode()).digest(), 0)
            assert n - len(rows) / (counters + 1) <= got <= n
        winners = ec.frequent_digests(docs, 12, 24)
        assert {r.group_size for r in winners.collect()} == {n for n in true.values() if n > len(rows) / 12}


def test_digests_that_end_in_zero_bytes(spark):
    text = next(f"{i}" for i in range(10**6) if hashlib.sha256(f"{i}".encode()).digest()[-1] == 0)
    rows = [(i, text) for i in range(40)] + [(100 + i, f"u{i}") for i in range(40)]
    assert result(spark, rows, frequent=5) == brute(rows)


def test_change_and_filter(spark):
    rows = [r for r in ROWS if r[0] != 12] + [(12, "twice"), (12, "twice"), (20, "TWICE")]
    got = ec.exact_copies(docs_of(spark, rows), change=F.upper).where("text_sha256 = sha2('TWICE', 256)")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(12, 20, 3), (20, 20, 3)}
    docs = docs_of(spark, ROWS)
    left = ec.without_copies(docs)
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {t or "" for _, t in ROWS}
    ids = {r.text: r.doc_id for r in left.collect()}
    assert ids["a"] == 6 and ids["twice"] == 12 and ids["null id"] is None
