"""How the sources of a language differ in the words they use.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased.  A
language keeps the terms that at least `least` of its documents hold (V of them).  A group, one
source of a language or the whole language, gives each kept term
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N being the group's count over all kept terms.  The
divergence of two groups in a term is floor((p - q)^2 / (p + q)).

1. Counting, in numpy, over length buckets: terms of up to eight bytes are packed into one uint64,
   up to sixteen bytes into two, and radix-sorted by digits of 16 bits; longer ones are sorted by
   bytes, each length for itself.  Sorts are stable and documents stand by group, so one pass over
   the runs yields the count and the number of documents of each term in each group.
2. Counts are dealt out by (language, term), so neither a hot language nor a hot source meets in one
   task, and a term has at most one row for each source and batch.
3. The kept terms of a language are dealt to blocks of terms; each block sums its divergences for
   every two sources and keeps its best terms.  Blocks are added up.

The result holds every two sources of a language, so it grows with the square of their number,
and a task holds one number for each such pair of one language; nothing else is unbounded.
Everything is exact: whole numbers of 64 bits, of any length where a count is beyond 9 * 10^9.

Edge cases: null text, language and source count as ''.  A group without terms has count 0
everywhere; a language without kept terms gives 0 for each pair and no terms.  Repeated rows count
each.  Ties are ordered by the item's UTF-8 bytes.  An empty table gives an empty result; further
columns are ignored, whatever their names.  Texts are read whole; those over BATCH_BYTES are
counted in pieces that end between terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwise.functions.basics import stored
from sumwise.llm.common import slices

SCALE = 10**9
BATCH_BYTES = 16 << 20
BLOCK_ROWS = 200_000  # rows (term, source) of a block
CELLS = 1 << 20  # terms x sources that are compared at once

#: Letters of a term, lower-cased; 0 for bytes between terms.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: The first bytes of a word of eight.
FIRST = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], np.uint64)

Counted = tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]  # terms, groups, counts, documents


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of numbers of 64 bits each, the first the most significant."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16 bits
    return order


def runs(keys: list[np.ndarray], order: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each (key, group) first stands in `order`, its count and its documents."""
    groups, docs = groups[order], docs[order]
    new = np.concatenate([[True], groups[1:] != groups[:-1]])
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    other = new.copy()
    other[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other.astype(np.int64), at)


def counted(data: bytes, doc_starts: np.ndarray, doc_groups: np.ndarray) -> Iterator[Counted]:
    """Terms of documents that stand below each other, zero bytes between them, groups ascending."""
    letters = LETTERS[np.frombuffer(b"\0" + data + bytes(16), np.uint8)]
    inside = letters != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    docs = np.searchsorted(doc_starts + 1, starts, "right") - 1
    groups = doc_groups[docs]
    eight = np.lib.stride_tricks.sliding_window_view(letters, 8)

    def word(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return eight[at].view(">u8").ravel().astype(np.uint64) & FIRST[size]

    for low, high in ((1, 8), (9, 16)):
        of = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(of):
            continue
        words = [word(starts[of], np.minimum(sizes[of], 8))]
        if low > 8:
            words.append(word(starts[of] + 8, sizes[of] - 8))
        first, n, held = runs(words, radix_order(words), groups[of], docs[of])
        packed = np.stack([w[first] for w in words], axis=1).astype(">u8")
        yield packed.view(f"S{8 * len(words)}").ravel().tolist(), groups[of][first], n, held
    long = np.flatnonzero(sizes > 16)
    for size in np.unique(sizes[long]).tolist():
        of = long[sizes[long] == size]
        bucket = letters[starts[of][:, None] + np.arange(size)].view(f"S{size}").ravel()
        first, n, held = runs([bucket], np.argsort(bucket, kind="stable"), groups[of], docs[of])
        yield bucket[first].tolist(), groups[of][first], n, held


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text of about `most` bytes that end between terms."""
    start = 0
    while len(text) - start > most:
        end = start + most
        while end < len(text) and LETTERS[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def long_text(text: bytes, most: int) -> Iterator[Counted]:
    """The terms of one text that is too long to be counted at once."""
    found: dict[bytes, int] = {}
    for piece in pieces(text, most):
        for terms, _, n, _ in counted(piece, np.zeros(1, np.int64), np.zeros(1, np.int64)):
            for term, k in zip(terms, n.tolist()):
                found[term] = found.get(term, 0) + k
    yield list(found), np.zeros(len(found), np.int64), np.array(list(found.values()), np.int64), np.ones(len(found), np.int64)


def term_counts(rows: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`lang`, `source`, term, n, docs of each batch; every group of a batch also has a row with an empty term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", batch_bytes):
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            names = sorted(set(pairs))
            place = {pair: k for k, pair in enumerate(names)}
            of = np.fromiter(map(place.__getitem__, pairs), np.int64, len(pairs))
            order = np.argsort(of, kind="stable")
            texts = batch.column("text").cast(pa.binary()).take(pa.array(order)).to_pylist()
            marks = np.arange(len(names))
            parts: list[Counted] = [([b""] * len(names), marks, np.zeros_like(marks), np.zeros_like(marks))]
            size = sum(map(len, texts))
            if size > batch_bytes:  # one long text, and empty ones
                (k,) = [k for k, t in enumerate(texts) if t]
                parts += [(t, g + of[order[k]], n, d) for t, g, n, d in long_text(texts[k], batch_bytes)]
            elif size:
                starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
                parts += counted(b"\0".join(texts), starts, of[order])
            for terms, groups, n, docs in parts:
                named = [pa.array([name[k] for name in names]).take(pa.array(groups)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*named, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"]
                )

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def weights(counts: np.ndarray, total: int) -> np.ndarray:
    """p of each count of a group, `total` being N + 2 V."""
    if counts.max(initial=0) > 9 * 10**9:
        counts = counts.astype(object)
    return (1 + (counts + 2) * SCALE // total).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_of(lang: str, found: pa.Table, groups: pa.Table, ranks: int) -> pa.Table:
    """Sums for every two sources of a language, and each one's best terms, over one block of terms."""
    sources, totals, about = groups["source"].to_pylist(), groups["total"].to_pylist(), groups.slice(0, 1).to_pylist()[0]
    place = {s: k for k, s in enumerate(sources)}
    terms = pc.unique(found["term"].combine_chunks()).cast(pa.binary())
    terms = terms.take(pc.array_sort_indices(terms))
    row = pc.index_in(found["term"].cast(pa.binary()), terms).to_numpy()
    by = np.argsort(row, kind="stable")
    row, n = row[by], found["n"].to_numpy()[by]
    of = np.fromiter((place[s] for s in found["source"].to_pylist()), np.int64, len(by))[by]
    sums = np.zeros((len(sources), len(sources)), np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in sources]
    step = max(1, CELLS // len(sources))
    for low in range(0, len(terms), step):
        cut = slice(*np.searchsorted(row, [low, low + step]))
        counts = np.zeros((len(sources), min(step, len(terms) - low)), np.int64)
        counts[of[cut], row[cut] - low] = n[cut]
        p = np.stack([weights(c, total + 2 * about["v"]) for c, total in zip(counts, totals)])
        q = weights(counts.sum(axis=0), about["whole"] + 2 * about["v"])
        for k in range(len(sources)):
            sums[k, k + 1 :] += divergence(p[k + 1 :], p[k]).sum(axis=1)
            over = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = divergence(p[k, over], q[over])
            first = np.lexsort((over, -value))[:ranks]
            best[k] = sorted([*best[k], *zip((-value[first]).tolist(), (over[first] + low).tolist())])[:ranks]
    sums += sums.T
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    names, top = pa.array(sources, pa.string()), [(k, t, -v) for k, rows in enumerate(best) for v, t in rows]
    mine, item, value = (list(c) for c in zip(*top)) if top else ([], [], [])
    size = len(a) + len(top)
    return pa.table(
        {
            "lang": pa.array([lang] * size, pa.string()),
            "source": names.take(pa.array(np.append(a, np.array(mine, np.int64)))),
            "part": pa.array(["pair"] * len(a) + ["term"] * len(top), pa.string()),
            "item": pa.chunked_array([names.take(pa.array(b)), terms.take(pa.array(item, pa.int64())).cast(pa.string())]),
            "value": pa.array(np.append(sums[a, b], np.array(value, np.int64))),
        }
    )


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, ranks: int = 10, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, value summed over all kept terms.  Part
    `term`: the `ranks` kept terms in which the source is most above its language.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    by_term = Window.partitionBy("lang", "term")
    # All rows of a (lang, term) are dealt to one task, so the two steps that follow need no further shuffle.
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumns({"all": F.sum("docs").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = stored(counts.where((F.col("all") >= least) | (F.col("term") == "")).drop("all", "docs"))
    is_term = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & is_term).alias("v"), F.count_if(is_term).alias("rows"))
    groups = stored(groups)
    size = groups.agg(F.sum("rows")).first()[0] or 0
    blocks = math.ceil(size / block_rows) or 1
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.sum("v").alias("v"))
    each = groups.select("lang", "source", "total").join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = kept.where(is_term).select("lang", "term", "source", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))

    def block(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return block_of(key[0].as_py(), left, right, ranks)

    sums = found.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(block, "lang string, source string, part string, item string, value long")
    sums = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return sums.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
