"""Packing into fixed-length sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder each. Only the histogram of
remainder lengths (at most ``length`` - 1 numbers) goes to the driver, where a linear
program over patterns (multisets of lengths that fit a sequence) is solved by column
generation. Its first basis is made of best-fit patterns of the histogram, scaled down to
a bounded number of items. A knapsack dynamic program prices new patterns for the simplex
method, and its duals bound the program from below, until none is worth more than a
sequence or the bound is met within ``gap``. Patterns are rounded down, what is left is
packed best-fit, and patterns are dealt to the documents by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.functions import running_total
from lacewing.llm.encode import encoder
from lacewing.llm.sharding import best_fit_decreasing, numbered
from lacewing.session import written

#: Rows of one length are ranked in so many independent parts.
PARTS = 64
#: Items that best fit takes at a time.
ITEMS = 20_000
#: What is added to how often a length is needed, at least, while the program is solved.
SLACK = 1e-3
#: Share of the best duals so far in those that columns are priced by.
SMOOTH = 0.8
#: Pivots between two inversions from scratch.
REFRESH = 1000


def knapsack(lengths: np.ndarray, values: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of a multiset of ``lengths`` (ascending) within each room, and its last pick."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(lengths, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if n := fits[w]:
            gain = best[w - lengths[:n]] + values[:n]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], pick[w] = gain[k], k
    return best, pick


def picked(lengths: np.ndarray, pick: np.ndarray, room: int) -> Counter:
    """The multiset (index -> copies) that a knapsack table chose for ``room``."""
    out, w = Counter(), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            out[int(pick[w])] += 1
            w -= int(lengths[pick[w]])
    return out


class Simplex:
    """A feasible basis of patterns: ``x`` times the patterns of ``basis`` uses each length as often as ``need`` says.

    A pattern costs a sequence. To use the place of a piece for the next shorter one costs nothing and
    is a column too: it keeps the duals in the order of the lengths, so that few columns have to be
    priced. It starts from single pieces. ``need`` is raised by a little for each length, so that no
    basic pattern is used 0 times and each pivot lowers the cost.

    Products go by ``einsum`` and inversion by pivots, not by a BLAS library: its threads have been
    seen to wait for ever in a process that had started a JVM.
    """

    def __init__(self, need: np.ndarray) -> None:
        m = len(need)
        self.need = need + np.random.default_rng(0).uniform(1, 2, m) * SLACK
        self.basis, self.cost = [Counter({i: 1}) for i in range(m)], np.ones(m)
        self.inverse, self.x, self.pivots = np.eye(m), self.need.copy(), 0

    def step(self, pattern: Counter) -> np.ndarray:
        """By how much the basic patterns fall when ``pattern`` is used once."""
        return np.einsum("ij,j->i", self.inverse[:, list(pattern)], np.array(list(pattern.values()), float))

    def duals(self) -> np.ndarray:
        return np.einsum("i,ij->j", self.cost, self.inverse)

    def pivot(self, out: int, step: np.ndarray) -> None:
        """The inverse after a column, ``step`` in terms of the basis, has taken the place ``out``."""
        row, rest = self.inverse[out] / step[out], step.copy()
        rest[out] = 0
        rows, cols = np.flatnonzero(np.abs(rest) > 1e-12), np.flatnonzero(row)
        self.inverse[np.ix_(rows, cols)] -= np.outer(rest[rows], row[cols])
        self.inverse[out] = row

    def replace(self, out: int, pattern: Counter, step: np.ndarray, often: float, cost: float = 1.0) -> None:
        """``pattern``, used ``often``, becomes basic in place of ``out``; the caller has moved the others."""
        self.pivot(out, step)
        self.basis[out], self.x[out], self.cost[out] = pattern, often, cost
        self.pivots += 1

    def refresh(self) -> None:
        """The inverse and ``x`` anew from the patterns, without the errors of the updates.

        Pivots from single pieces again, short patterns first as they fill in less; of the places
        that are left a pattern takes the one where it counts most.
        """
        m = len(self.need)
        old, cost = self.basis, self.cost
        self.basis, self.cost, self.inverse = [Counter()] * m, np.ones(m), np.eye(m)
        free = np.ones(m, bool)
        for k in sorted(range(m), key=lambda k: (len(old[k]), k)):
            step = self.step(old[k])
            out = int(np.where(free, np.abs(step), -1).argmax())
            self.pivot(out, step)
            self.basis[out], self.cost[out], free[out] = old[k], cost[k], False
        self.x = np.maximum(np.einsum("ij,j->i", self.inverse, self.need), 0)

    def first_used_up(self, fall: np.ndarray) -> tuple[int, float]:
        """Which basic pattern is used up first as they fall, and when; of equals the one that falls fastest."""
        ratio = np.full(len(fall), np.inf)
        np.divide(self.x, fall, out=ratio, where=fall > 1e-7)
        by = float(ratio.min())
        ties = np.flatnonzero(ratio <= by + 1e-9)
        return int(ties[fall[ties].argmax()]), by

    def enter(self, pattern: Counter, cost: float) -> None:
        """A pivot that brings in ``pattern``."""
        step = self.step(pattern)
        out, by = self.first_used_up(step)
        self.x = np.maximum(self.x - by * step, 0)
        self.replace(out, pattern, step, by, cost)
        if self.pivots % REFRESH == 0:
            self.refresh()

    def start(self, seeds: list[tuple[Counter, int]]) -> None:
        """From a whole plan to a basis that is no worse: each of its patterns becomes basic or is given up.

        A pattern that is not basic is used more or less, whichever lowers the sum of ``x``, until a
        basic one is used up and it takes its place, or until it isn't used any more.
        """
        for pattern, often in seeds:
            self.x[list(pattern)] -= np.array(list(pattern.values()), float) * often
        for pattern, often in seeds:
            step = self.step(pattern)
            fall = step if step.sum() > 1 + 1e-9 else -step
            out, by = self.first_used_up(fall)
            if fall is not step and by >= often:
                self.x = np.maximum(self.x + often * step, 0)
            else:
                self.x = np.maximum(self.x - by * fall, 0)
                self.replace(out, pattern, step, often + by if fall is step else often - by)


def cutting_stock(counts: dict[int, int], room: int, gap: float = 1e-3, max_rounds: int = 200_000) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) and how often each is used; together they use ``counts`` exactly.

    The linear program starts from the best-fit plan. That plan stands only where the program's,
    rounded to whole sequences, needs more of them.
    """
    seeds = best_fit_patterns(counts, room)
    found = column_generation(counts, room, seeds, gap, max_rounds)
    return found if sum(n for _, n in found) <= sum(n for _, n in seeds) else seeds


def best_fit_patterns(counts: dict[int, int], room: int, items: int = ITEMS) -> list[tuple[dict[int, int], int]]:
    """Best-fit patterns of the histogram over a divisor that leaves at most ``items`` items, so often each.

    What the division drops is a smaller histogram, packed in the same way; so patterns
    grow with the logarithm of the number of documents.
    """
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        scale = max(1, sum(left.values()) // items)
        pieces = [k for k, n in sorted(left.items()) for _ in range(n // scale)]
        bins: dict[int, Counter] = {}
        for k, b in zip(pieces, best_fit_decreasing(pieces, room), strict=True):
            bins.setdefault(b, Counter())[k] += 1
        same = Counter(tuple(sorted(b.items())) for b in bins.values())
        out += [(dict(p), n * scale) for p, n in same.items()]
        left = {k: n % scale for k, n in left.items() if n % scale}
    return out


def column_generation(counts: dict[int, int], room: int, seeds: list[tuple[dict[int, int], int]], gap: float, max_rounds: int, width: int = 256) -> list[tuple[dict[int, int], int]]:
    """The linear program by the revised simplex method, rounded down, and best fit for the rest.

    ``seeds`` is a plan to start from, or empty. Columns are priced until none is worth more
    than a sequence or the program is within ``gap`` of the bound that the duals prove; it is
    an error if ``max_rounds`` pivots don't suffice.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    need = np.array([counts[int(k)] for k in lengths], float)
    at = {int(k): i for i, k in enumerate(lengths)}
    program = Simplex(need)
    program.start([(Counter({at[k]: c for k, c in p.items()}), often) for p, often in seeds])
    # the duals with the best bound so far, at first tokens per sequence
    center = lengths / room
    bound, smooth = float(center @ program.need), SMOOTH
    while True:
        own = program.duals()
        if float(program.cost @ program.x) <= bound * (1 + gap):
            break
        # duals near the best ones swing less; the program's own are priced where those give no column
        price = smooth * center + (1 - smooth) * own
        best, pick = knapsack(lengths, price, room)
        if (proved := float(price @ program.need) / float(best[room])) > bound:
            bound, center = proved, price / float(best[room])
        if not smooth and best[room] <= 1 + 1e-7:
            break
        # with each length the best that fits beside it: one table prices many columns
        gains, pool = price + best[room - lengths], []
        for i in np.argsort(-gains, kind="stable")[:width].tolist():
            pattern = picked(lengths, pick, room - int(lengths[i]))
            pattern[i] += 1
            if sum(own[k] * c for k, c in pattern.items()) > 1 + 1e-7:
                pool.append(pattern)
        smooth = SMOOTH if pool else 0.0
        if not pool:
            continue
        columns = np.zeros((len(pool), len(lengths)))
        for k, pattern in enumerate(pool):
            columns[k, list(pattern)] = list(pattern.values())
        while True:
            own = program.duals()
            worth = np.concatenate([np.einsum("ij,j->i", columns, own) - 1, np.append(0, own[:-1]) - own])
            if worth.max() <= 1e-7:
                break
            if program.pivots >= max_rounds:
                raise RuntimeError(f"packing: {max_rounds} pivots leave the linear program at {program.cost @ program.x:.1f} sequences, bound {bound:.1f}")
            k = int(worth.argmax())
            shorter = k - len(pool)
            program.enter(*((pool[k], 1.0) if shorter < 0 else (Counter({shorter: -1} | ({shorter - 1: 1} if shorter else {})), 0.0)))
    plan = [(pattern, int(often + 1e-6)) for pattern, often, cost in zip(program.basis, program.x, program.cost, strict=True) if cost]
    plan, left = within(plan, need.astype(np.int64))
    found = [({int(lengths[i]): c for i, c in pattern.items()}, often) for pattern, often in plan if pattern]
    return found + best_fit_patterns({int(k): int(n) for k, n in zip(lengths, left, strict=True)}, room)


def within(plan: list[tuple[Counter, int]], need: np.ndarray) -> tuple[list[tuple[Counter, int]], np.ndarray]:
    """``plan`` with places that ``need`` has no piece for given to shorter pieces, or left empty; and the need it leaves."""
    by: dict[int, list[tuple[Counter, int]]] = {}
    out, left = [], need.copy()
    for pattern, often in plan:
        if often:
            by.setdefault(max(pattern), []).append((pattern, often))
    # each entry waits at the longest place that is not settled yet; ``done`` is what is
    open_ = {i: [(Counter(p), Counter(), n) for p, n in rows] for i, rows in by.items()}
    for i in range(len(need) - 1, -1, -1):
        for rest, done, often in sorted(open_.pop(i, []), key=lambda e: (-e[2], sorted(e[1].items()), sorted(e[0].items()))):
            copies = rest.pop(i)
            full = min(often, int(left[i]) // copies)
            some = int(left[i] - full * copies) if full < often else 0
            for n, kept in ((full, copies), (1 if some else 0, some), (often - full - (1 if some else 0), 0)):
                if n:
                    left[i] -= n * kept
                    own, more = done + Counter({i: kept}), rest.copy()
                    if i and kept < copies:
                        more[i - 1] += copies - kept
                    if more:
                        open_.setdefault(max(more), []).append((more, own, n))
                    else:
                        out.append((own, n))
    return out, left


def pieces(docs: DataFrame, tokenizer: str, end: int, length: int) -> DataFrame:
    """``(row, doc_id, start, length, ids_crc32, doc_tokens, full)``: documents cut at multiples of ``length``."""
    tail = np.array([end], np.uint32)
    names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out = []
                for row, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids = np.concatenate([e.ids(text or ""), tail]).astype("<u4").tobytes()
                    n = len(ids) // 4
                    out += [(row, doc, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names)).withColumn("full", F.col("length") == length)


def _seated(rest: DataFrame, ranges: list[tuple[int, ...]]) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of ranked remainders.

    ``ranges(size, low, high, often, first, base)`` tile the ranks of each size; a row finds its
    range by binary search in the sorted table, which is broadcast: ITEMS rows for each doubling
    digit of the histogram at most.
    """
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    names = [*own, "sequence_id", "offset"]
    table = np.array(sorted(ranges), np.int64).reshape(-1, 6)
    shared = rest.sparkSession.sparkContext.broadcast(table)

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, _, often, first, base = shared.value.T
        sizes = np.unique(size)
        # ranges of a size lie together: their lows go on from its first row's place in one line
        step = int(low.max()) + 1 if len(low) else 1
        line = np.searchsorted(sizes, size) * step + low
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(line, np.searchsorted(sizes, length) * step + np.minimum(rank, step - 1), side="right") - 1
            nth = rank - low[at]
            seat = first[at] + nth % often[at], base[at] + nth // often[at] * size[at]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *map(pa.array, seat)], names=names)

    return rest.select(*own, "rank").mapInArrow(seated, ", ".join(f"{n} long" for n in names))


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, length: int = 1024, parts: int = PARTS) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, a row per piece.

    A document of ``docs(doc_id, text)`` is its ids and the end id. Null text counts as
    empty: one id. Very long texts are encoded whole and cut. Repeated rows and rows without
    an id are packed each. Sequence ids and offsets are gapless from 0. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end, length), "pieces")
    counts = {r["length"]: r["n"] for r in cut.filter("NOT full").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges, used, first = [], Counter(), 0
    for pattern, often in cutting_stock(counts, length):
        offset = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            ranges.append((size, used[size], used[size] + copies * often, often, first, offset))
            used[size] += copies * often
            offset += size * copies
        first += often
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rest = cut.filter("NOT full").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    packed = _seated(numbered(rest, "length", "part", ["row"], "rank"), ranges)
    one = cut.filter("full").withColumn("one", F.lit(1).cast("long"))
    whole = running_total(one, ["row", "start"], "one", "nth").select(*own, (F.lit(first) + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
