"""I-Match fingerprints over randomised subsets of the lexicon.

The lexicon holds the terms whose document frequency over all documents lies in a band: terms
in a larger part of the documents say nothing about one of them, terms in a smaller part are
mostly noise.  A document keeps its distinct terms of the lexicon, sorted.  Its signature is
the hash of all of them.  Further hashes are taken over SUBSETS families of random subsets of
the lexicon; a family has nested subsets with half, a quarter, an eighth ... of the terms, and a
document uses the smallest one in which it still has a term.  The likeness of two
fingerprints is the part of the families in which they agree.

A lexicon term is in at least `least` of the documents, so there are at most D / `least` terms,
D being the mean number of distinct terms of a document, however many documents there are.
That bound is what allows to broadcast their 64-bit hashes, up to MOST_TERMS of them.  A larger
lexicon is joined with the terms of the documents instead, with the same result.

Terms are what stands between ASCII white space, with A-Z lower-cased and signs at either end
removed.  A document with fewer than FEW terms in the lexicon uses all its distinct terms.

Edge cases: a null text counts as empty; an empty text has an empty fingerprint, which is like
another empty one (1.0) and unlike all others (0.0).  Rows with the same id stand in the order of
the hashes of their texts; null ids come last.  A single document is its own next one.  An empty table
gives an empty result, further columns are ignored.  Texts are read whole; a task holds two
documents besides its batch, and the last document of a task meets the first one of the next
task in a join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwise.functions.basics import stored
from sumwise.llm.common import slices
from sumwise.llm.shingles import FACTORS, mix

LEAST, MOST = 1 / 2000, 1 / 20
MOST_TERMS = 4_000_000
SUBSETS = 32
FEW = 3
BATCH_BYTES = 8 << 20
SIGNS = b".,;:!?\"'()[]{}<>*#$%&-_/"
SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))[:, None]


def term_hashes(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct terms."""
    terms = {w.strip(SIGNS) for w in (text or "").encode().lower().split()}
    terms.discard(b"")
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)))


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> str:
    """Signature and one hash per family; `terms` and `lexicon` are sorted."""
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        kept = terms[lexicon[at] == terms]
        if len(kept) >= FEW:
            terms = kept
    if not len(terms):
        return ""
    ranks = mix(terms[None, :] ^ SEEDS) >> np.uint64(1)
    # The smallest subset that is met: ranks below the first power of two above the smallest rank.
    limit = ranks.min(axis=1)
    for shift in (1, 2, 4, 8, 16, 32):
        limit = limit | limit >> np.uint64(shift)
    limit = limit + np.uint64(1)
    inside = ranks < limit[:, None]
    place = np.cumsum(inside, axis=1).astype(np.uint64)  # of a term in its subset, in sorted order
    hashes = np.where(inside, mix(terms[None, :] * FACTORS[0] + place * FACTORS[1]), np.uint64(0)).sum(axis=1, dtype=np.uint64)
    short = mix(hashes ^ limit * FACTORS[2]) >> np.uint64(40)
    return hashlib.sha1(terms.tobytes()).hexdigest()[:16] + ":" + "".join(f"{h:06x}" for h in short.tolist())


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = a[17:], b[17:]
    return sum(x[i : i + 6] == y[i : i + 6] for i in range(0, len(x), 6)) / SUBSETS


def lexicon_rows(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """`term`: hashes of the terms in more than `least` and at most `most` of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [term_hashes(t) for t in batch.column("text").to_pylist()]
            terms, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"))
    total = rows.count()
    often = rows.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return stored(often.where((F.col("n") > total * least) & (F.col("n") <= total * most)).select("term"))


def lexicon_of(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The terms of `lexicon_rows`, sorted."""
    return sorted_terms(lexicon_rows(docs, text, least, most))


def sorted_terms(chosen: DataFrame) -> np.ndarray:
    return np.sort(chosen.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """`id` and OUT of every row: its fingerprint, that of its edited text, and their likeness.

    The edited text ends in as many characters of the next document (descending id, the last
    one followed by the first) as half of the text has.
    """
    chosen = lexicon_rows(docs, text, least, most)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    if chosen.count() > MOST_TERMS:
        found = printed_by_join(with_next(rows, terms_of_both, SETS, SETS_ARROW), chosen)
    else:
        lexicon = rows.sparkSession.sparkContext.broadcast(sorted_terms(chosen))
        found = with_next(rows, lambda one, after: prints_of_both(one, after, lexicon.value), OUT, OUT_ARROW)
    return found.withColumnRenamed("id", id)


def edited_text(text: str | None, after: str | None) -> str:
    whole, other = text or "", after or ""
    half = len(whole) // 2
    return whole[: len(whole) - half] + other[:half]


def prints_of_both(one: dict, after: dict, lexicon: np.ndarray) -> dict:
    """A row of OUT."""
    for r in (one, after):
        if r.get("print") is None:
            r["print"] = fingerprint(term_hashes(r["text"]), lexicon)
    edited = edited_text(one["text"], after["text"])
    changed = fingerprint(term_hashes(edited), lexicon)
    return {
        "id": one["id"],
        "n_chars": len(one["text"] or ""),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": one["print"],
        "edited_fingerprint": changed,
        "near_edited": likeness(one["print"], changed),
        "near_next": likeness(one["print"], after["print"]),
    }


SETS = "n_chars long, edited_sha256 string, sets array<array<bigint>>"
SETS_ARROW = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("sets", pa.list_(pa.list_(pa.int64())))]


def terms_of_both(one: dict, after: dict) -> dict:
    """A row of SETS: the terms of the text, of the edited text and of the next document."""
    edited = edited_text(one["text"], after["text"])
    return {
        "id": one["id"],
        "n_chars": len(one["text"] or ""),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "sets": [term_hashes(t).view(np.int64).tolist() for t in (one["text"], edited, after["text"])],
    }


def printed_by_join(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """`id` and OUT from SETS, where the lexicon is too large for a task."""
    kind = found.schema["id"].dataType.simpleString()
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()))
    terms = rows.select("row", F.posexplode("sets").alias("kind", "terms")).select("row", "kind", F.explode("terms").alias("term"))
    kept = terms.join(chosen, "term").groupBy("row").agg(F.collect_list(F.struct("kind", "term")).alias("kept"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("id"), *OUT_ARROW])
            out = []
            for r in batch.to_pylist():
                inside: list[list[int]] = [[], [], []]
                for k in r["kept"] or ():
                    inside[k["kind"]].append(k["term"])
                lexicons = [np.sort(np.array(k, np.int64).view(np.uint64)) for k in inside]
                own, edited, after = (fingerprint(np.array(t, np.int64).view(np.uint64), x) for t, x in zip(r["sets"], lexicons))
                prints = {"fingerprint": own, "edited_fingerprint": edited}
                out.append({**r, **prints, "near_edited": likeness(own, edited), "near_next": likeness(own, after)})
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in out], schema=schema)

    return rows.join(kept, "row", "left").mapInArrow(printed, f"id {kind}, {OUT}")


def with_next(rows: DataFrame, made: Callable[[dict, dict], dict], columns: str, arrow: list) -> DataFrame:
    """What `made` returns for every row (`id, text`) and the next one.

    Rows are dealt out by ranges of the id, so a row finds the next one in its own task.  Each
    task also leaves its first and its last row; the last one of a task is joined with the first
    one of the next task that has rows.  Only the numbers of the tasks are put in order at once.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, out, schema = None, [], None
        for batch in slices(batches, "text", 1 << 20):
            schema = pa.schema([batch.schema.field("id"), *arrow, ("text", pa.string()), ("edge", pa.int32()), ("task", pa.int32())])
            for one in batch.to_pylist():
                if last is None:
                    out.append({"id": one["id"], "text": one["text"], "edge": 0, "task": task})
                else:
                    out.append(made(last, one))
                last = one
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"id": last["id"], "text": last["text"], "edge": 1, "task": task}], schema=schema)

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            schema = pa.schema([batch.schema.field("id"), *arrow])
            out = [made({"id": r["id"], "text": r["text"]}, {"text": r["next_text"]}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # Ranges are found from a sample on the driver: of ids and hashes, not of texts.
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").asc()]
    parts = max(1, math.ceil(rows.count() / 5000))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    found = stored(dealt.mapInArrow(in_task, f"id {kind}, {columns}, text string, edge int, task int"))
    first = found.where("edge = 0").select(F.col("task").alias("after"), F.col("text").alias("next_text"))
    last = found.where("edge = 1").select("task", "id", "text")
    tasks = Window.orderBy("task")
    after = last.select("task", F.coalesce(F.lead("task").over(tasks), F.first("task").over(tasks)).alias("after"))
    pairs = last.join(after, "task").join(first, "after").select("id", "text", "next_text")
    return found.where("edge is null").drop("text", "edge", "task").union(pairs.mapInArrow(at_edges, f"id {kind}, {columns}"))


OUT_ARROW = [
    (name, {"long": pa.int64(), "double": pa.float64()}.get(kind, pa.string())) for name, kind in (f.split() for f in OUT.split(", "))
]
