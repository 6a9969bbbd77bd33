"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. Every text becomes its set of shingles and a sketch of COORDINATES places.  Sketching goes
   in rounds: a round throws every shingle into a hashed place, and a place keeps the
   smallest value of the first round that reached it.  After as many rounds as there are
   places, one round per place takes all shingles, so every place fills, however small the
   set.  Two sets agree in a place with the probability of their Jaccard similarity, with the
   concentration of independent draws.
2. Equal sets become one node, counted before the shuffle, so copies never meet as pairs.
3. ROWS places in a row form a band.  Nodes that agree in a whole band share a bucket.  At a
   similarity of 0.75 two nodes share none of the BANDS buckets once in 400,000 cases.
4. In each bucket the member with the most company and the smallest one lead.  Members are
   compared with their leaders only, on full sets: a bucket of m nodes costs 2 m pairs.
5. Where a bucket still holds several components, an exact prefix filter over the full sets of
   its members finds all pairs across components that can be similar, and these are compared
   too, so no link is left out.
6. Components come from alternating stars.

Edge cases: a null or empty text, or one without words, has an empty set, is linked with
nothing and is its own component.  Fewer than five words are one shingle.  Repeated rows have
equal sets, hence one component; each keeps its row, and all rows with the smallest id count
as kept.  A null id never is a component id while others exist in the component.  Further
columns are ignored; an empty table gives an empty result.  Texts are read whole; a row's
memory grows with its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwise.functions.basics import stored
from sumwise.llm.common import slices
from sumwise.llm.components import components
from sumwise.llm.shingles import mix, shingle_set

BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
BATCH_BYTES = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], places: int = COORDINATES) -> np.ndarray:
    """One row of `places` values per non-empty set."""
    sizes = [len(s) for s in sets]
    found = np.full(len(sets) * places, EMPTY, np.uint64)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    first = np.repeat(np.arange(len(sets)) * places, sizes)
    for turn in range(2 * places):
        if not len(items):
            break
        h = mix(items, turn + 1)
        place = (h >> np.uint64(32)) * np.uint64(places) >> np.uint64(32) if turn < places else turn - places
        np.minimum.at(found, first + np.asarray(place, np.int64), np.uint64(turn << 48) | h & np.uint64((1 << 48) - 1))
        open_rows = (found.reshape(-1, places) == EMPTY).any(axis=1)
        still = open_rows[first // places]
        items, first = items[still], first[still]
    return found.reshape(-1, places)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different bands having different keys."""
    bands = sketch.shape[1] // rows
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands))
    for i in range(rows):
        keys = mix(keys ^ sketch[:, i::rows][:, :bands], i + 1) + np.uint64(i)
    return keys


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.zeros((len(sets), 0), np.uint64)
        full = [s for s in sets if len(s)]
        if full:
            made = band_keys(sketches(full))
            keys = np.zeros((len(sets), made.shape[1]), np.uint64)
            keys[sizes > 0] = made
        names = [
            int(mix(s, 1).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(s, 2).sum(dtype=np.uint64)).to_bytes(8, "big") if len(s) else None
            for s in sets
        ]
        counts = np.where(sizes > 0, keys.shape[1], 0)
        bands = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _signed(keys[sizes > 0].ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("h"), pa.array(sizes), pa.array(names, pa.binary()), bands],
            schema=pa.schema(
                [batch.schema.field("id"), ("h", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))]
            ),
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))],
            schema=pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))]),
        )


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _full_sets(rows: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes that share a bucket, from one row of each."""
    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node")
    wanted = wanted.select("node", F.col("row.id").alias("want"), F.col("row.h").alias("h"))
    texts = rows.join(wanted, "h").where(F.col("id").eqNullSafe(F.col("want"))).select("node", "text")
    return texts.mapInArrow(_sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """`id`, n_shingles, component_id (smallest id of the group) and kept of every row."""
    found = _grouped(docs, id, text, percent)
    return found.select(F.col("id").alias(id), "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of `docs`, all columns, that stay: those with the smallest id of their group.

    Rows of a group whose ids are all null stay too.
    """
    go = _grouped(docs, id, text, percent).where("not kept").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__h"))
    return docs.join(go, same, "left_anti")


def _grouped(docs: DataFrame, id: str, text: str, percent: int) -> DataFrame:
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    known = stored(rows.mapInArrow(_sketched, f"id {kind}, h long, n_shingles long, set_id binary, bands array<long>"))
    nodes = stored(
        known.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min("id").alias("label"),
            F.min(F.struct("id", "h")).alias("row"),
            F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(shared, "bucket"))
    sets = stored(_full_sets(rows, nodes, members))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = (
        members.join(company, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("company", "node")).getField("node").alias("most"), F.min(F.struct("size", "node")).getField("node").alias("least"))
        .select("bucket", F.explode(F.array_distinct(F.array("most", "least"))).alias("a"))
    )
    stars = members.join(leaders, "bucket").where("node != a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    tried = stored(stars.distinct())
    links = stored(linked(tried, sets, percent))
    found = stored(components(links))
    rest = stored(_rest(members, found, sets, percent).join(tried, ["a", "b"], "left_anti"))
    more = stored(linked(rest, sets, percent))
    found = stored(components(links.union(more)))
    return _finished(known, nodes, found)


def _rest(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that can still be similar, among nodes whose bucket spans components.

    Order the shingles of these nodes from rare to frequent.  Similar sets x and y share at least
    o = percent * (|x| + |y|) / (100 + percent) shingles, and all of these stand from the first shared
    one on; so at that place either set has o shingles left.  What many nodes share, such as a
    common passage, comes last: it leaves enough only where it makes the sets similar.
    """
    parts = members.join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part"))
    spans = parts.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("bucket")
    nodes = parts.join(spans, "bucket").select("node", "part").distinct()
    items = sets.join(nodes, "node").select("node", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    items = stored(items)
    often = items.groupBy("s").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "s"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = items.join(often, "s").withColumn("place", place).where((F.col("place") <= prefix) & (F.col("often") > 1))
    first = stored(first.select("s", "node", "part", "n", "place"))
    other = first.select("s", *[F.col(c).alias(f"{c}_b") for c in ("node", "part", "n", "place")])
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    like = (left * (100 + percent) >= percent * (F.col("n") + F.col("n_b"))) & (F.col("part") != F.col("part_b"))
    pairs = first.join(other, "s").where((F.col("node") < F.col("node_b")) & like)
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _finished(known: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    tied = found.join(nodes.select("node", "label"), "node")
    least = tied.groupBy("root").agg(F.min("label").alias("least"))
    group = nodes.join(tied.select("node", "root").join(least, "root").select("node", "least"), "node", "left")
    group = stored(group.select("set_id", F.coalesce("least", "label").alias("component")))
    rows = known.select("id", "h", "n_shingles", "set_id").join(group, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component"))
    return rows.select("id", "h", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
