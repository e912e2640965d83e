"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

#: An odd multiplier of the polynomial hash, and its powers' inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i], x = x, x * BASE % (1 << 64)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` items; equal runs have equal hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k, p in enumerate(powers(n)):
        out += hashes[k : k + count] * p
    return mixed(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted different hashes of runs of ``n`` words, A-Z in lower case.

    Fewer words are one run; without words the set is empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return mixed(windows(word_hashes(words), len(words)) + np.uint64(len(words)))
    return np.unique(windows(word_hashes(words), n))
