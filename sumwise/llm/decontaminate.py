"""Passages of benchmark items in documents, by SimHash windows and multi-index Hamming blocks.

An item of n words is compared with every window of n words of every document (with the whole
document where that is shorter):

1. Only an item of which the document holds enough shingles can be in it, so a document goes on
   with the sizes of such items, mostly none.  Of their windows only those can be similar enough
   that share 75 / 175 of the shingles of window and item together with some item; running sums of
   such hits find them.
2. Those windows get a SimHash of BITS bits.  Each shingle has a weight per bit that its hash
   gives, so equal sums do not occur; running sums give all windows of a document.
3. Fingerprints of the items of that size are cut into RADIUS + 1 blocks.  Two fingerprints
   within RADIUS bits agree in at least one block, so looking up the blocks finds every item
   within the radius.
   A SimHash adds up counts, so a repeated shingle can turn it far from one that is similar by
   step 4.  Where the item or the window repeats a shingle, fingerprints do not decide: every
   window left by step 1 is a candidate for each item of which the document has enough shingles.
4. The candidates' shingles, weighted by how often they occur, are compared exactly:
   sum of smaller counts / sum of larger counts >= 0.75.

At the lowest similarity two fingerprints differ in 22 of 128 bits on average, with a deviation
of 4.3 if neither repeats a shingle; RADIUS loses about one in 50,000 of such borderline windows
and next to none above.  Where one repeats a shingle, nothing is lost.

Edge cases: words and shingles as in `shingles`; fewer than five words are one shingle, so a
short item is found only in a document that consists of it.  Null or empty items and documents
match nothing.  Repeated items count once, repeated documents are reported each.  Empty tables
give empty results (without items all documents are clean).  Further columns are ignored by
the search and kept by the filter.  Texts are read whole.

The items are broadcast in blocks of at most BLOCK_BYTES of text; a larger benchmark takes
more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.llm.common import per_worker, slices
from sumwise.llm.shingles import hashes_of, mix, shingles_of, words_of

BITS, RADIUS = 128, 40
BLOCK_BYTES = 8 << 20
SPAN = 4096  # windows that are fingerprinted together
EDGES = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]


def shingle_sequence(text: str | None) -> np.ndarray:
    return shingles_of(hashes_of(words_of(text)))


def weights(shingles: np.ndarray) -> np.ndarray:
    """One weight per bit, from -127.5 to 127.5 in steps of 1, doubled to stay whole."""
    drawn = [mix(shingles, 1000 + i) for i in range(BITS // 8)]
    return np.stack(drawn, axis=1).view(np.uint8).astype(np.int64) * 2 - 255


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> list[int]:
    """SimHash of `width` shingles from each of the sorted `starts`."""
    out = []
    while len(starts):
        n = np.searchsorted(starts, starts[0] + SPAN)
        group, starts = starts[:n], starts[n:]
        part = weights(shingles[group[0] : group[-1] + width])
        sums = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(part, axis=0)])
        at = group - group[0]
        bits = np.packbits(sums[at + width] - sums[at] > 0, axis=1)
        out += [int.from_bytes(row.tobytes(), "big") for row in bits]
    return out


def blocks_of(print_: int) -> Iterator[tuple[int, int]]:
    for k in range(RADIUS + 1):
        yield k, print_ >> EDGES[k] & (1 << EDGES[k + 1] - EDGES[k]) - 1


def previous(shingles: np.ndarray) -> np.ndarray:
    """Where each shingle stands before, -1 for the first."""
    order = np.argsort(shingles, kind="stable")
    same = shingles[order[1:]] == shingles[order[:-1]]
    out = np.full(len(shingles), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def repeating(before: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of `width` shingles from each start holds one of them twice."""
    at = np.flatnonzero(before >= 0)
    low = np.maximum(at - width + 1, 0)
    at, low = at[low <= before[at]], low[low <= before[at]]
    n = len(before) + 1
    return np.cumsum(np.bincount(low, minlength=n) - np.bincount(before[at] + 1, minlength=n)) > 0


class Index:
    """The items, by their number of shingles and the blocks of their fingerprints."""

    def __init__(self, texts: list[str], percent: int):
        self.percent = percent
        self.shingles = [shingle_sequence(t) for t in texts]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.prints = [fingerprints(s, np.zeros(1, np.int64), len(s))[0] if len(s) else None for s in self.shingles]
        self.blocks: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, (s, print_) in enumerate(zip(self.shingles, self.prints)):
            if print_ is not None:
                for block in blocks_of(print_):
                    self.blocks[len(s)][block].append(number)
        self.all = np.unique(np.concatenate(self.shingles)) if texts else np.empty(0, np.uint64)
        self.sizes = np.array([len(s) for s in self.shingles], np.int64)
        self.repeats = {len(s) for s, c in zip(self.shingles, self.counts) if len(c) < len(s)}  # sizes
        own = [np.unique(s) for s in self.shingles]
        held = np.concatenate(own) if texts else self.all
        order = np.argsort(held, kind="stable")
        self.holders = np.repeat(np.arange(len(own)), [len(s) for s in own])[order]
        self.places = np.append(np.searchsorted(held[order], self.all), len(held))
        # A bit per hash tells most foreign shingles apart before the search in `all`.
        self.mask = np.uint64((1 << max(16, int(len(self.all)).bit_length() + 4)) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[self.all & self.mask] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        found = self.maybe[shingles & self.mask]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.all, shingles[at]), len(self.all) - 1)
            found[at] = self.all[place] == shingles[at]
        return found

    def near(self, shingles: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Items of which the document holds as many shingles as one similar window would."""
        at, n = np.unique(np.searchsorted(self.all, shingles[hit]), return_counts=True)
        holders = np.concatenate([self.holders[self.places[k] : self.places[k + 1]] for k in at])
        counts = np.bincount(holders, np.repeat(n, self.places[at + 1] - self.places[at]), len(self.sizes))
        return np.flatnonzero((self.sizes > 0) & self.enough(counts, self.sizes, np.minimum(self.sizes, len(shingles))))

    def enough(self, shared: np.ndarray, size: np.ndarray | int, width: np.ndarray | int) -> np.ndarray:
        """Whether so many shared shingles can make `percent` of all: shared / (size + width - shared)."""
        return (100 + self.percent) * shared >= self.percent * (size + width)

    def within_radius(self, size: int, print_: int) -> set[int]:
        blocks = self.blocks[size]
        near = {number for block in blocks_of(print_) for number in blocks.get(block, ())}
        return {number for number in near if (self.prints[number] ^ print_).bit_count() <= RADIUS}

    def similarity(self, number: int, window: np.ndarray) -> tuple[int, int]:
        """Sums of the smaller and of the larger counts."""
        item, other = self.counts[number], Counter(window.tolist())
        shared = sum(min(n, other[s]) for s, n in item.items())
        return shared, len(window) + item.total() - shared

    def found(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best, first window of each item in the text."""
        shingles = shingle_sequence(text)
        hit = self.hits(shingles)
        if not hit.any():
            return []
        near = self.near(shingles, hit)
        if not len(near):
            return []
        sums = np.concatenate([[0], np.cumsum(hit)])
        out, before = [], None
        for size in np.unique(self.sizes[near]).tolist():
            width = min(size, len(shingles))
            inside = sums[width:] - sums[:-width]
            starts = np.flatnonzero(self.enough(inside, size, width))
            if not len(starts):
                continue
            windows = defaultdict(list)
            for start, print_ in zip(starts.tolist(), fingerprints(shingles, starts, width)):
                for number in self.within_radius(size, print_):
                    windows[number].append(start)
            before = previous(shingles) if before is None else before
            again = starts[repeating(before, width)[starts]]
            if len(again) or size in self.repeats:
                for number in near[self.sizes[near] == size].tolist():
                    more = starts if len(self.counts[number]) < size else again
                    if len(more):
                        windows[number] = np.union1d(np.array(windows.get(number, []), np.int64), more).tolist()
            for number, places in windows.items():
                if best := self.best(number, shingles, np.array(places), width):
                    out.append((number, best[1], width + max(0, len(words_of(text)) - len(shingles)), best[0]))
        return out

    def best(self, number: int, shingles: np.ndarray, starts: np.ndarray, width: int) -> tuple[float, int] | None:
        """Highest similarity and its first window; a bound from the shared places is tried first."""
        low, high = starts[0], starts[-1] + width
        shared = np.concatenate([[0], np.cumsum(np.isin(shingles[low:high], self.shingles[number]))])
        inside = shared[starts - low + width] - shared[starts - low]
        total = width + len(self.shingles[number])
        bounds = inside / np.maximum(total - inside, 1)
        best = None
        for k in np.lexsort((starts, -bounds)).tolist():
            if 100 * bounds[k] < self.percent or best and bounds[k] < best[0]:
                break
            a, b = self.similarity(number, shingles[starts[k] : starts[k] + width])
            if 100 * a >= self.percent * b and (best is None or (a / b, -starts[k]) > (best[0], -best[1])):
                best = (a / b, int(starts[k]))
        return best


def index_of(texts: list[str], key: str, percent: int) -> Index:
    """The index over the texts of one block, named by `key`; a Python worker keeps the last one it made."""
    kept = per_worker("passages", dict)
    if (key, percent) not in kept:
        kept.clear()
        kept[key, percent] = Index(texts, percent)
    return kept[key, percent]


def item_blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of each block of items."""
    items = benchmark.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("length(text) > 0").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = -(-size // BLOCK_BYTES)
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).collect()
        yield [r.id for r in rows], [r.text for r in rows]


def benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 75
) -> DataFrame:
    """`id`, `item`, first_word, n_words, similarity: a row for each document and each item found in it."""
    spark = docs.sparkSession
    types = f"id {docs.schema[id].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}, first_word long, n_words long, similarity double"
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def pass_over(block: tuple[list, list[str]]) -> DataFrame:
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            index = index_of(texts, key, percent)
            for batch in slices(batches, "text", 1 << 20):
                out = []
                for row, doc in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    out += [(row, ids[number], start, words, like) for number, start, words, like in index.found(doc)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["id", "item", "first_word", "n_words", "similarity"])

        return rows.mapInArrow(search, types)

    found = spark.createDataFrame([], types)
    for block in item_blocks(benchmark, item, item_text):
        found = found.union(pass_over(block))
    return found.withColumnsRenamed({"id": id, "item": item})


def without_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 75
) -> DataFrame:
    """The rows of `docs`, all columns, in which no item is found."""
    spark, kept = docs.sparkSession, docs
    for _, texts in item_blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(texts)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value, key, percent)
            for batch in slices(batches, text, 1 << 20):
                yield batch.filter(pa.array([not index.found(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
