"""Canonical length-limited Huffman codes for token ids, vectorised.

A code is its array of lengths by id. Documents are coded byte-aligned, in segments of
``SEGMENT`` ids whose bit offsets are the checkpoints: a decoder looks up one symbol of
every segment of a block at a time.
"""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints.
SEGMENT = 128


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Bits of each id by package-merge, 0 where the count is 0.

    ``limit`` defaults to two bits over what a fixed-length code would take.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n < 2:
        out[used] = 1
        return out
    least = int(n - 1).bit_length()
    limit = max(limit or least + 2, least)
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaves, row = [], weights
    for level in range(limit):
        if level:
            pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            at = np.argsort(both, kind="stable")
            row, leaf = both[at], at < n
        else:
            leaf = np.ones(n, bool)
        leaves.append(leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


class Code:
    """The canonical code of some lengths: by length, then by id."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        span = np.int64(1) << (self.bits - self.lengths[ids])
        start = np.concatenate([[0], np.cumsum(span)])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (start[:-1] >> (self.bits - self.lengths[ids])).astype(np.uint64)
        #: For each possible next ``bits`` bits: the id, and how many bits are its own.
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.symbol[: start[-1]] = np.repeat(ids, span)
        self.length = self.lengths[self.symbol].astype(np.int64)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of ``counts`` ids each: their bytes, bytes per document, checkpoints.

        Checkpoints are bit offsets into the bytes, one for each begun segment of a document.
        """
        if not len(ids):
            return np.empty(0, np.uint8), np.zeros(len(counts), np.int64), np.empty(0, np.int64)
        bits = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(bits)])
        stops = np.cumsum(counts)
        firsts = stops - counts
        taken = (ends[stops] - ends[firsts] + 7) // 8
        base = np.cumsum(taken) - taken
        at = ends[:-1] + np.repeat(base * 8 - ends[firsts], counts)
        value = self.codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        cuts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        words = np.zeros(int(word[-1]) + 3, np.uint64)
        words[word[cuts]] += np.add.reduceat(value >> np.uint64(32), cuts)
        words[word[cuts] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), cuts)
        data = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: int(taken.sum())]
        within = np.arange(len(ids)) - np.repeat(firsts, counts)
        return data, taken, at[within % SEGMENT == 0]

    def decode(self, data: np.ndarray, counts: np.ndarray, checkpoints: np.ndarray) -> np.ndarray:
        """The ids of a block, all segments in step."""
        out = np.empty(int(counts.sum()), np.uint32)
        if not len(out):
            return out
        pieces = -(-counts // SEGMENT)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(np.cumsum(counts) - counts, pieces) + nth * SEGMENT
        size = np.minimum(np.repeat(counts, pieces) - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        at, first, size = checkpoints[order].astype(np.int64), first[order], size[order]
        b = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        live = np.searchsorted(-size, -np.arange(SEGMENT), side="left")
        mask, shift = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for k in range(int(size[0])):
            n = int(live[k])
            p = at[:n]
            bits = (windows[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[first[:n] + k] = self.symbol[bits]
            at[:n] = p + self.length[bits]
        return out
