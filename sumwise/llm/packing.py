"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest capacity are cut into pieces of it and a rest; no token is
lost.  Pieces are dealt into groups of about GROUP_TOKENS tokens and GROUP_ROWS rows, whatever
their ids, so no key makes a large group; each group is packed by itself:

* Pieces go from long to short, each into the open bin whose space it leaves least of.
* Where none has room, a bin is opened.  Every permitted capacity is tried: it is filled in
  thought with the longest pieces that are left and still fit, and the capacity with the
  least cost per token is opened (the larger one of equals).  Lengths of all sizes are so
  chosen together, by what is still to come.
* In the end each bin shrinks to the smallest capacity that holds its content.

A group holds lengths and row numbers, no text.  The cost of a capacity is its number of
tokens plus OVERHEAD for the sequence itself.  Groups cost at most one badly filled bin each.

Edge cases: a null or empty document is a piece of no tokens and stands in no sequence (null);
a null id is kept; repeated rows are packed each; equal lengths go in the order of their rows.
An empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD = 16
GROUP_TOKENS = 8 << 20
GROUP_ROWS = 100_000


def byte_tokens(text: str = "text") -> Column:
    """Tokens of a byte-level vocabulary."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")


class Lengths:
    """How many pieces of each length are left; a bit per length finds the longest that fits."""

    def __init__(self, lengths: Sequence[int]):
        self.left: dict[int, int] = {}
        self.bits = 0
        for n in lengths:
            self.left[n] = self.left.get(n, 0) + 1
            self.bits |= 1 << n

    def take(self, n: int) -> None:
        self.left[n] -= 1
        if not self.left[n]:
            self.bits ^= 1 << n

    def fill(self, space: int) -> int:
        """Tokens that the longest fitting pieces bring into the space, one after the other."""
        start, used = space, {}
        bits = self.bits & (1 << space + 1) - 1
        while bits:
            n = bits.bit_length() - 1
            times = min(self.left[n] - used.get(n, 0), space // n)
            used[n] = used.get(n, 0) + times
            space -= n * times
            bits &= (1 << min(n, space + 1)) - 1
        return start - space


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of every piece; all lengths are from 1 to the largest capacity."""
    capacities = sorted(set(capacities))
    left = Lengths(lengths)
    open_bins: dict[int, list[int]] = {}  # by space
    spaces = 0
    content: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        left.take(n)
        roomy = spaces >> n
        if roomy:
            space = n + (roomy & -roomy).bit_length() - 1
            bin_ = open_bins[space].pop()
            if not open_bins[space]:
                spaces ^= 1 << space
        else:
            space = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / (n + left.fill(c - n)), -c))
            bin_ = len(content)
            content.append(0)
        placed[i] = (bin_, content[bin_])
        content[bin_] += n
        space -= n
        if space:
            open_bins.setdefault(space, []).append(bin_)
            spaces |= 1 << space
    sizes = [next(c for c in capacities if c >= t) for t in content]
    return [(b, at, sizes[b]) for b, at in placed]


def packed(
    docs: DataFrame,
    tokens: Column | None = None,
    id: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
) -> DataFrame:
    """`id`, piece, first_token, n_tokens, sequence, capacity, offset: where every piece of every document stands.

    `tokens` is the number of tokens of a row, by default those of a byte-level vocabulary.
    """
    kind = docs.schema[id].dataType.simpleString()
    largest = max(capacities)
    n = byte_tokens() if tokens is None else tokens
    rows = docs.select(F.col(id).alias("id"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.ceil(F.col("n") / largest) + 1), F.lit(0)).alias("rows")).first()
    groups = max(1, -(-size.tokens // GROUP_TOKENS), -(-size.rows // GROUP_ROWS))
    pieces = rows.select("id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)))).alias("piece"))
    dealt = pieces.select(
        "id",
        "row",
        "piece",
        (F.col("piece") * largest).alias("first_token"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("part"),
    )

    def pack_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
        full = part["n_tokens"] > 0
        found = pack(part.loc[full, "n_tokens"].tolist(), capacities, overhead)
        for k, name in enumerate(("sequence", "offset", "capacity")):
            part[name] = pd.Series([f[k] for f in found], index=part.index[full], dtype="Int64").reindex(part.index)
        part["sequence"] = part["sequence"] + (int(key[0]) << 32)
        return part[["id", "piece", "first_token", "n_tokens", "sequence", "capacity", "offset"]]

    out = f"id {kind}, piece long, first_token long, n_tokens long, sequence long, capacity long, offset long"
    return dealt.groupBy("part").applyInPandas(pack_group, out).withColumnRenamed("id", id)
