"""Vectors as codes of PARTS indexes into codebooks fitted in whole numbers.

A component x counts as floor(256 x).  A vector is cut into PARTS equal parts; each part position
has a codebook, which starts as that part of the ENTRIES vectors with the smallest ids.  A round
assigns every part to its nearest entry (squared distance, ties to the lower index) and moves each
entry to the componentwise floor of its parts' mean; unused entries stay.  After ROUNDS rounds
parts are assigned once more.

1. Rows are gathered to chunks of at most CHUNK_CELLS components.  In a chunk, the parts of each
   position are sorted along a Hilbert curve and cut into flat blocks of BLOCK neighbours, each with
   its min/max box and its sum.  Chunks are written once; later steps read only them.
2. In each round a block keeps the entries whose least distance from its box is not above the
   smallest greatest distance of any entry: no part of the block can be nearest to another one.
   Where one entry is left, the block's count and sum are added as they are.  Other blocks are
   compared with their shortlist by kernels of whole numbers, blocks with lists of like length
   together.
3. Tasks send one row for each number of the codebooks, added up before the driver reads them:
   ENTRIES times the length of a vector, whatever the corpus.

Edge cases: rows whose vector is null or holds a null or non-finite component are dropped.  Fewer
than ENTRIES rows make as many entries; null ids come after all others, rows with equal ids in the
order of their vectors.  A vector shorter than the longest one, or than the next multiple of PARTS,
counts as padded with zeros.  Equal vectors have equal codes.  Labels may be null (null labels
belong together).  An empty table gives an empty result; further columns are ignored, whatever
their names.  Components are compared in 64 bits; a table whose squared distances do not fit them
(at 64 components: one beyond +-524,288) raises ValueError, as `error` could not hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import join_on, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 64
CHUNK_CELLS = 1 << 20
KERNEL_CELLS = 1 << 19
MOST_LABELS = 100_000  # labels whose sums are broadcast
SALTS = 32  # shares of a label beyond that


def kept_vectors(rows: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """id, label, v of the rows whose components are all finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.select(F.col(id).alias("id"), F.col(label).alias("label"), v.alias("v")).where(v.isNotNull() & finite)


def whole(vectors: list[np.ndarray], length: int) -> np.ndarray:
    out = np.zeros((len(vectors), length), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(SCALE * v)
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (n x axes, whole numbers of `bits` bits) on a Hilbert curve."""
    x = [c.astype(np.uint64) for c in cells.T]
    one, zero = np.uint64(1), np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        below = np.uint64((1 << bit) - 1)
        for i in range(len(x)):
            turned = x[i] >> np.uint64(bit) & one == one
            swap = np.where(turned, zero, (x[0] ^ x[i]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> np.uint64(bit) & one == one, np.uint64((1 << bit) - 1), zero)
    key = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | (axis ^ flip) >> np.uint64(bit) & one
    return key


def curve_order(values: np.ndarray) -> np.ndarray:
    """Sorts points along a Hilbert curve over their ten widest axes."""
    low, high = values.min(axis=0), values.max(axis=0)
    axes = np.sort(np.argsort(low - high, kind="stable")[:10])
    bits = min(8, 60 // max(1, len(axes)))
    span = np.maximum(high - low, 1)[axes]
    cells = (values[:, axes] - low[axes]) * ((1 << bits) - 1) // span
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


def boxes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest components and the sums of blocks of BLOCK rows."""
    at = np.arange(0, len(values), BLOCK)
    return np.minimum.reduceat(values, at), np.maximum.reduceat(values, at), np.add.reduceat(values.astype(np.int64), at)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Blocks x entries: whether the entry may be nearest to some part within the block's box."""
    below, above = low[:, None] - book, book - high[:, None]
    nearest = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(below), np.abs(above))
    return (nearest**2).sum(axis=2) <= (farthest**2).sum(axis=2).min(axis=1)[:, None]


def nearest_entries(values: np.ndarray, chosen: np.ndarray, book: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of the parts in the blocks `which`, each compared with its shortlist."""
    entries, distances = np.zeros((len(chosen), BLOCK), np.int64), np.zeros((len(chosen), BLOCK), np.int64)
    sizes = chosen.sum(axis=1)
    lists = np.argsort(~chosen, axis=1, kind="stable")  # the chosen ones come first, lower index first
    padded = np.concatenate([values, np.repeat(values[-1:], -len(values) % BLOCK, axis=0)]).reshape(len(chosen), BLOCK, values.shape[1])
    width = 1
    while len(which):
        now, which = which[sizes[which] <= width], which[sizes[which] > width]
        step = max(1, KERNEL_CELLS // (BLOCK * width))
        for k in range(0, len(now), step):
            of = now[k : k + step]
            # Shorter lists repeat their first entry, which an equal distance never replaces.
            some = np.where(np.arange(width)[: len(book)] < sizes[of, None], lists[of, :width], lists[of, :1])
            sums = np.zeros((len(of), BLOCK, some.shape[1]), values.dtype)
            for axis in range(values.shape[1]):
                apart = padded[of, :, axis, None] - book[some, axis][:, None, :]
                sums += apart * apart
            first = sums.argmin(axis=2)
            entries[of] = np.take_along_axis(some, first, axis=1)
            distances[of] = np.take_along_axis(sums, first[:, :, None], axis=2)[:, :, 0]
        width *= 2
    return entries.ravel()[: len(values)], distances.ravel()[: len(values)]


def totals(values: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many parts are nearest to each entry, and their sums."""
    chosen = shortlists(low, high, book)
    alone = chosen.sum(axis=1) == 1
    sizes = np.minimum(BLOCK, len(values) - np.arange(len(low)) * BLOCK)
    count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    np.add.at(count, chosen[alone].argmax(axis=1), sizes[alone])
    np.add.at(total, chosen[alone].argmax(axis=1), sums[alone])
    entries, _ = nearest_entries(values, chosen, book, np.flatnonzero(~alone))
    rest = np.repeat(~alone, sizes)
    count += np.bincount(entries[rest], minlength=len(book))
    for axis in range(book.shape[1]):
        np.add.at(total[:, axis], entries[rest], values[rest, axis])
    return count, total


def small_kind(values: np.ndarray) -> str:
    """The narrowest type of whole numbers that holds the values."""
    most = int(np.abs(values).max(initial=0))
    return next(kind for kind, top in (("i1", 1 << 7), ("i2", 1 << 15), ("i4", 1 << 31), ("i8", 1 << 63)) if most < top)


class Chunk:
    """One stored row: ids, labels, and the sorted parts of each position with their blocks."""

    FIELDS = ("order", "sorted", "low", "high", "sums")
    SCHEMA = f"ids array<{{id}}>, labels array<{{label}}>, kind string, parts array<struct<{', '.join(f'{name}: binary' for name in FIELDS)}>>"
    PARTS = pa.list_(pa.struct([(name, pa.binary()) for name in FIELDS]))

    @staticmethod
    def packed(values: np.ndarray) -> tuple[str, list[dict[str, bytes]]]:
        kind, parts = small_kind(values), []
        for part in np.split(values, PARTS, axis=1):
            order = curve_order(part) if part.size else np.arange(len(part))
            low, high, sums = boxes(part[order])
            parts.append({"order": order.astype("i4").tobytes(), "sorted": part[order].astype(kind).tobytes(), "low": low.astype(kind).tobytes(), "high": high.astype(kind).tobytes(), "sums": sums.tobytes()})
        return kind, parts

    @staticmethod
    def parts(kind: str, parts: list[dict[str, bytes]], width: int, wide: str) -> Iterator[tuple[np.ndarray, ...]]:
        for p in parts:
            order = np.frombuffer(p["order"], "i4")
            shape = (-(-len(order) // BLOCK), width)
            low, high = (np.frombuffer(p[name], kind).astype("i8").reshape(shape) for name in ("low", "high"))
            yield order, np.frombuffer(p["sorted"], kind).astype(wide).reshape(len(order), width), low, high, np.frombuffer(p["sums"], "i8").reshape(shape)


def chunks(vectors: DataFrame, length: int) -> DataFrame:
    """`Chunk` rows of the kept vectors."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    size = max(BLOCK, CHUNK_CELLS // max(1, length))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            vectors = rows["v"].combine_chunks()
            ends, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            kind, parts = Chunk.packed(whole([flat[a:b] for a, b in zip(ends, ends[1:])], length))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows[c].combine_chunks()) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([kind]), pa.array([parts], Chunk.PARTS)], names=["ids", "labels", "kind", "parts"])

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in waiting) == size:
                    yield chunk(pa.Table.from_batches(waiting))
                    waiting = []
        if waiting:
            yield chunk(pa.Table.from_batches(waiting))

    return vectors.mapInArrow(gather, Chunk.SCHEMA.format(**kinds))


def moved(found: DataFrame, books: np.ndarray, wide: str) -> np.ndarray:
    """The codebooks after one round; `books` is parts x entries x components."""
    shared = found.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for kind, parts in zip(batch.column("kind").to_pylist(), batch.column("parts")):
                for k, (_, values, low, high, sums) in enumerate(Chunk.parts(kind, parts.as_py(), books.shape[2], wide)):
                    n, s = totals(values, low, high, sums, books[k])
                    count[k] += n
                    total[k] += s
        part, entry, place = (axis.ravel() for axis in np.indices(books.shape))
        columns = [part, entry, place, np.repeat(count.ravel(), books.shape[2]), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "n", "total"])

    sums = found.mapInArrow(add, "part long, entry long, place long, n long, total long")
    books = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect():
        books[r.part, r.entry, r.place] = r.total // r.n
    return books


def coded(found: DataFrame, books: np.ndarray, wide: str) -> DataFrame:
    """id, label, code, error of every vector."""
    shared = found.sparkSession.sparkContext.broadcast(books)
    kinds = {c: found.schema[c + "s"].dataType.elementType.simpleString() for c in ("id", "label")}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digits = shared.value, np.array([f"{k:02x}" for k in range(256)], "S2")
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, parts = (batch.column(c)[row] for c in ("ids", "labels", "parts"))
                code, error = np.zeros((len(ids), PARTS), np.int64), np.zeros(len(ids), np.int64)
                for k, (order, values, low, high, _) in enumerate(Chunk.parts(batch.column("kind")[row].as_py(), parts.as_py(), books.shape[2], wide)):
                    code[order, k], apart = nearest_entries(values, shortlists(low, high, books[k]), books[k], np.arange(len(low)))
                    error[order] += apart
                text = pa.array(digits[code].view(f"S{2 * PARTS}").ravel().tolist(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, text, pa.array(error)], names=["id", "label", "code", "error"])

    return found.mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def first_vectors(vectors: DataFrame, most: int, length: int) -> np.ndarray:
    """The `most` vectors with the smallest ids, in whole numbers."""
    ids = [r.id for r in vectors.where("id is not null").select("id").orderBy("id").limit(most).collect()]
    few = vectors.where(F.col("id") <= F.lit(ids[-1])) if len(ids) == most else vectors
    return whole([np.array(r.v) for r in few.orderBy(F.col("id").asc_nulls_last(), "v").limit(most).collect()], length)


def with_label_errors(codes: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """`codes` with the error summed over all rows of the same label."""
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= most_labels:
        return join_on(codes, F.broadcast(sums), ["label"])
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")), salted, ["label", "salt"]).drop("salt")


def vector_codes(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`id`, code, error, label_error, codebooks_sha256 of every kept vector."""
    vectors = kept_vectors(rows, id, vector, label)
    length, most = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = -(-(length or 0) // PARTS)
    length = PARTS * width
    limit = length * (2 * (int(most or 0) + 1) * SCALE) ** 2  # above every squared distance
    if limit >= 1 << 63:
        raise ValueError("components are too large for distances of 64 bits")
    wide = "i4" if limit < 1 << 31 else "i8"
    books = first_vectors(vectors, ENTRIES, length)
    books = books.reshape(len(books), PARTS, width).transpose(1, 0, 2)
    found = stored(chunks(vectors, length))
    for _ in range(ROUNDS if books.size else 0):
        books = moved(found, books, wide)
    hash_ = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = stored(coded(found, books, wide))
    return with_label_errors(codes).select(F.col("id").alias(id), "code", "error", "label_error", F.lit(hash_).alias("codebooks_sha256"))
