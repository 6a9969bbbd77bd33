"""Words, shingles and their hashes, as near-duplicate operators take them.

A-Z are lower-cased, words are what stands between white space (space, tab to carriage
return).  A shingle is five words in a row; a text of fewer words is one shingle as a whole.
Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(31)


def words_of(text: str | None) -> list[bytes]:
    """Exactly the ASCII white space separates and only A-Z change: both are what bytes do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a sequence of words, in order, repeated ones included."""
    n = len(hashes)
    width = min(WIDTH, n)
    if not n:
        return hashes
    made = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        made = made + hashes[i : n - width + 1 + i] * FACTORS[i]
    return mix(made)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingles of a text; empty without words."""
    return np.unique(shingles_of(hashes_of(words_of(text))))
