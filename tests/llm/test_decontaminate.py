"""Benchmark passages against all windows by brute force."""

import random
import re
from collections import Counter

from sumwise.llm import decontaminate as dc

RNG = random.Random(4)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\\x20\\x09-\\x0D]+", low) if w]


def shingles(ws):
    return [tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, min(1, len(ws))))]


def brute(docs, items):
    out = []
    for i, text in docs:
        doc = words(text)
        for k, item_text in sorted(set(items), key=str):
            item = words(item_text)
            if not item:
                continue
            b, best = Counter(shingles(item)), None
            have, size = shingles(doc), len(shingles(item))
            near = {s for at, x in enumerate(have) if x in b for s in range(at - size + 1, at + 1)}  # others share nothing
            for start in sorted(near & set(range(max(1, len(doc) - len(item) + 1)))):
                window = have[start : start + size]
                a = Counter(window)
                top = sum((a & b).values()), sum((a | b).values())
                if 100 * top[0] >= 75 * top[1] and (best is None or top[0] / top[1] > best[0]):
                    best = (top[0] / top[1], start)
            if best:
                out.append((i, k, best[1], round(best[0], 9)))
    return sorted(out, key=str)


def text(n, vocabulary=400):
    return [f"w{RNG.randrange(vocabulary)}" for _ in range(n)]


def made():
    items = [(i, " ".join(text(RNG.choice([5, 6, 14, 30, 45])))) for i in range(25)]
    items += [(90, "so few words"), (91, ""), (92, None), (0, items[0][1]), (93, "again " * 20), (94, "Cased ITEM words that Are five or more")]
    docs = []
    for n in range(140):
        body = text(RNG.choice([0, 3, 50, 200]))
        for _ in range(RNG.choice([0, 1, 1, 2])):
            passage = (RNG.choice(items)[1] or "").split()
            for _ in range(RNG.choice([0, 0, 1, 1, 2])):
                if passage:
                    passage[RNG.randrange(len(passage))] = "edited"
            if RNG.random() < 0.3:
                passage = passage[RNG.randrange(1, 4) :]
            at = RNG.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((n, RNG.choice([" ", "\n", " \t"]).join(body)))
    docs += [(200, None), (201, ""), (202, "SO FEW words"), (203, "so few words more"), (204, "again " * 60), (205, "again " * 17)]
    docs += [(206, "x cased item WORDS that are five or more"), (206, "x cased item WORDS that are five or more"), (None, items[5][1]), (207, "v " * 30000 + items[3][1])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, item_id string, similarity int"),
        spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string"),
    )


def test_against_all_windows(spark):
    docs, items = made()
    got = dc.benchmark_passages(*frames(spark, docs, items)).collect()
    found = sorted(((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got), key=str)
    assert found == brute(docs, items)


def test_filter_keeps_all_columns_of_clean_rows(spark):
    docs, items = made()
    bad = {(i, t) for i, t in docs if brute([(i, t)], items)}
    got = dc.without_passages(*frames(spark, docs, items)).collect()
    assert sorted(((r.doc_id, r.text, r.item_id, r.similarity) for r in got), key=str) == sorted(
        ((i, t, "z", 1) for i, t in docs if (i, t) not in bad), key=str
    )


def test_many_blocks_find_the_same(spark, monkeypatch):
    docs, items = made()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    got = dc.benchmark_passages(*frames(spark, docs, items)).collect()
    assert sorted(((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c d e f")], [])
    assert dc.benchmark_passages(docs, items).collect() == []
    assert dc.without_passages(docs, items).count() == 1
    assert dc.benchmark_passages(docs.limit(0), frames(spark, [], [(1, "a b c d e")])[1]).collect() == []


def test_blocks_guarantee_the_radius():
    index = dc.Index([" ".join(text(30, 10**6)) for _ in range(50)], 75)
    size = len(index.shingles[0])
    for number, print_ in enumerate(index.prints):
        for far in (0, 1, dc.RADIUS - 1, dc.RADIUS, dc.RADIUS + 1):
            changed = print_
            for bit in RNG.sample(range(dc.BITS), far):
                changed ^= 1 << bit
            assert (number in index.within_radius(size, changed)) == (far <= dc.RADIUS)


def test_repeated_shingles_lose_no_window():
    rng = random.Random(9)
    for n in range(60):
        body = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        if n % 2:  # the item ends in a run of its own
            body[90:] = ["same"] * 14
        passage = body[:90] + ["junk"] * 14
        item = " ".join(body)
        doc = " ".join(["x", "y", *passage, *(f"z{k}" for k in range(n))])
        found = [(1, number, start, round(like, 9)) for number, start, _, like in dc.Index([item, "other " * 9], 75).found(doc)]
        assert found == brute([(1, doc)], [(0, item)]) and found


def test_windows_that_repeat_a_shingle():
    rng = random.Random(10)
    for _ in range(200):
        have = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        width = rng.randrange(1, len(have) + 1)
        got = dc.repeating(dc.previous(dc.np.array(have)), width)
        assert got[: len(have) - width + 1].tolist() == [len(set(have[k : k + width])) < width for k in range(len(have) - width + 1)]
