"""Fingerprints: the edited text by hand, and likeness that follows what is shared."""

import hashlib
import random

import numpy as np
import xxhash

from sumwise.llm import fingerprints as fp

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(900)]


def docs_of(n):
    return [(i * 3, " ".join(RNG.choices(WORDS, k=RNG.choice([0, 1, 4, 60, 200])))) for i in range(n)]


def expected(rows):
    def place(text):
        h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    order = sorted(rows, key=lambda r: ((r[0] is None), -(r[0] or 0), place(r[1])))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    return fp.edited_fingerprints(docs, **more).collect()


def test_edited_texts_and_likeness(spark):
    rows = docs_of(400) + [(5000, None), (5001, "é漢🙂 x"), (5002, "a"), (5002, "b"), (None, "no id"), (5003, "word " * 20000)]
    got = run(spark, rows, least=0.002, most=0.5)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    long = [r for r in got if 100 < r.n_chars < 5000]
    assert np.mean([r.near_edited for r in long]) > 0.1 + np.mean([r.near_next for r in long])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(i, "same text in every row of it" if i % 2 else f"other {i} text") for i in range(40)]
    got = {r.fingerprint for r in run(spark, rows) if r.doc_id % 2}
    assert len(got) == 1 and "" not in got


def test_many_tasks_meet_at_their_edges(spark):
    rows = [(i, f"text number {i}") for i in range(11_000)]
    got = run(spark, rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)


def test_a_lexicon_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    rows = docs_of(300) + [(5000, None), (5001, "a"), (5001, "a"), (None, "no id"), (5003, "word " * 2000)]
    expected = sorted(run(spark, rows, least=0.002, most=0.5), key=str)
    monkeypatch.setattr(fp, "MOST_TERMS", 0)
    assert sorted(run(spark, rows, least=0.002, most=0.5), key=str) == expected
    assert run(spark, []) == [] and len(run(spark, [(1, "one two")])) == 1


def test_likeness_to_the_next_one_across_tasks(spark):
    rows = [(i, f"text number {i // 2} of {i % 7}") for i in range(11_000)]
    lexicon = np.empty(0, np.uint64)
    prints = [fp.fingerprint(fp.term_hashes(t), lexicon) for _, t in rows]
    got = {r.doc_id: r for r in run(spark, rows, least=1.0)}
    assert all(got[i].fingerprint == p and got[i].near_next == fp.likeness(p, prints[i - 1]) for i, p in enumerate(prints))


def test_one_row_and_none(spark):
    (one,) = run(spark, [(1, "abcd ef")])
    assert one.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest() and one.near_next == 1.0
    assert run(spark, []) == []
    (empty,) = run(spark, [(1, None)])
    assert (empty.n_chars, empty.fingerprint, empty.near_edited) == (0, "", 1.0)


def test_lexicon_counts_all_documents(spark):
    rows = [(f"rare{i} common " + ("some " * 3 if i % 4 == 0 else "")).strip() for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    assert fp.lexicon_of(docs, least=0.2, most=0.5).tolist() == fp.term_hashes("some").tolist()
    assert len(fp.lexicon_of(docs, least=0.0, most=1.0)) == 202


def test_signature_ignores_order_and_repeats():
    lexicon = np.empty(0, np.uint64)
    a, b = (fp.fingerprint(fp.term_hashes(t), lexicon) for t in ("b a, c a", "C (b) a"))
    assert a == b and fp.likeness(a, b) == 1.0
