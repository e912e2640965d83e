"""Digram substitution: repeated neighbour pairs become rules, in batched rounds.

Each round counts adjacent pairs, accepts the most frequent pairs whose symbols are
disjoint (they cannot interfere), and replaces all their occurrences. ``batch=1`` takes
one pair per round, which is the exact greedy grammar up to tie-breaks.

Rounds work on segments of adjacency rows as arrays, whose length is bounded, so a hub's
row is spread over tasks. Replacing is a narrow pass over Arrow batches; what is shuffled
in a round is counts of pairs, added up per batch before.

A pair of symbols that were there before a round can't become more frequent in it. So after
the first round only pairs that repeated in the last one, by a filter of hashes, and pairs
with a new rule are counted, and a segment that has neither is done and is not read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacewing.model import SEGMENT, CompressedGraph, Graph, GraphMeta
from lacewing.session import drop_path, settled, table_path, written

#: Segments that a pass over a batch looks at together.
SLICE = 256
#: Pairs that the driver goes through by itself, the most frequent first; of more, executors choose.
GATHERED = 131072
#: Bits of a filter for each pair in it, and the most bits that a filter has.
PAIR_BITS, MOST_BITS = 16, 1 << 28
#: Bytes of a part of a filter, as executors hand it in.
PART = 4096
ROUNDS = "id long, seg long, syms array<long>, round long"


class Known(NamedTuple):
    """What is known of pairs before they are counted anew."""

    #: Bits at the places of the pairs that repeated when last counted.
    bits: np.ndarray
    #: The first of the rules made since.
    since: int


def _places(left: np.ndarray, right: np.ndarray, since: int, size: int) -> np.ndarray:
    """Two places of each pair in a filter of ``size`` bits; they differ from round to round."""
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (right + since).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    h ^= h >> np.uint64(33)
    return np.stack([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def _set(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))


def _candidates(symbols: np.ndarray, cuts: np.ndarray, known: Known | None) -> np.ndarray:
    """Where replaceable pairs begin that may repeat, in segments laid end to end."""
    at = np.flatnonzero(_starts(symbols, cuts))
    if known is None or not len(at):
        return at
    left, right = symbols[at], symbols[at + 1]
    maybe = (left >= known.since) | (right >= known.since)
    old = np.flatnonzero(~maybe)
    places = _places(left[old], right[old], known.since, len(known.bits) * 8)
    maybe[old] = ((known.bits[places >> 3] >> (places & 7)) & 1).all(axis=0)
    return at[maybe]


def _starts(symbols: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where a replaceable pair begins in segments laid end to end, cut at ``cuts``.

    A run of one symbol pairs up from its right end, so an odd one stays on the left.
    """
    n = len(symbols)
    joined = np.ones(n, bool)
    joined[cuts[1:][cuts[1:] > 0] - 1] = False
    same = joined.copy()
    same[:-1] &= symbols[1:] == symbols[:-1]
    ends = np.flatnonzero(~same)
    run_end = np.repeat(ends, np.diff(ends, prepend=-1))
    return joined & (~same | ((run_end - np.arange(n)) % 2 == 1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of ``(id, seg, syms)`` in parts, with the symbols of a part and its cuts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            b = batch.slice(at, SLICE)
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            yield b, b.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _segments(strings: DataFrame) -> DataFrame:
    """``(id, seg, syms)`` of strings: a segment is one array, as long as a segment may be."""
    row = F.sort_array(F.collect_list(F.struct("pos", "sym")))
    return strings.groupBy("id", "seg").agg(F.transform(row, lambda x: x["sym"]).alias("syms"))


def _sorted_segments(edges: DataFrame, segment: int) -> tuple[DataFrame, str]:
    """``_segments`` of rows sorted by ``dst``, and the path of their table: cut as edges come sorted, in one shuffle.

    Rows in several partitions, one for each partition at most, are cut again by their places.
    """
    spark, path = edges.sparkSession, table_path(edges.sparkSession, "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, before = TaskContext.get().partitionId(), None, 0
        src = dst = seg = np.empty(0, np.int64)

        def runs(cuts: np.ndarray, end: int) -> pa.RecordBatch:
            ids, ends = src[cuts], np.append(cuts, end)
            syms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(dst[:end]))
            columns = [np.full(len(ids), part), ids == head, ids, seg[cuts], np.diff(ends)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), syms], names=["part", "head", "id", "seg", "n", "syms"])

        for b in batches:
            if not b.num_rows:
                continue
            src, dst = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate((src, dst)))
            head = src[0] if head is None else head
            starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            lengths = np.diff(starts, append=len(src))
            pos = np.arange(len(src)) - np.repeat(starts, lengths)
            pos[: lengths[0]] += before
            seg = pos // segment
            cuts = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (seg[1:] != seg[:-1])]))
            # the last one may go on
            last = cuts[-1]
            if last:
                yield runs(cuts[:-1], last)
            before, src, dst, seg = pos[last], src[last:], dst[last:], seg[last:]
        if len(src):
            yield runs(np.zeros(1, np.int64), len(src))

    ordered = edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    runs = written(ordered.mapInArrow(cut, "part long, head boolean, id long, seg long, n long, syms array<long>"), "runs", path)
    first = F.broadcast(runs.filter("head").select("id").distinct())
    held: dict[int, list] = {}
    for r in runs.join(first, "id", "left_semi").groupBy("id", "part").agg(F.sum("n").alias("n")).orderBy("id", "part").collect():
        held.setdefault(r["id"], []).append((r["part"], r["n"]))
    places = [(k, part, sum(n for _, n in parts[:i])) for k, parts in held.items() if len(parts) > 1 for i, (part, _) in enumerate(parts)]
    spread = F.broadcast(spark.createDataFrame(places, "id long, part long, before long"))
    place = (F.col("before") + F.col("seg") * segment + F.col("k")).cast("long")
    again = runs.join(spread, ["id", "part"]).select("id", "seg", "before", F.posexplode("syms").alias("k", "sym")).select("id", place.alias("pos"), "sym")
    again = _segments(again.select("id", F.floor(F.col("pos") / segment).alias("seg"), "pos", "sym"))
    return runs.join(spread, "id", "left_anti").select("id", "seg", "syms").unionByName(again), path


def _frequencies(segments: DataFrame, known: Known | None = None) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, symbols, cuts in _slices(batches):
            at = _candidates(symbols, cuts, known)
            if not len(at):
                continue
            left, right = symbols[at], symbols[at + 1]
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
            n = np.diff(first, append=len(left))
            yield pa.RecordBatch.from_arrays([pa.array(left[first]), pa.array(right[first]), pa.array(n, pa.int64())], names=["left", "right", "freq"])

    pairs = segments.mapInArrow(counted, "left long, right long, freq long")
    return pairs.groupBy("left", "right").agg(F.sum("freq").alias("freq")).filter("freq >= 2")


def pair_frequency(strings: DataFrame) -> DataFrame:
    """``(left, right, freq)`` of the replaceable pairs that occur at least twice."""
    return _frequencies(_segments(strings))


def _disjoint(pairs: list, batch: int) -> list:
    taken, out = set(), []
    for p in pairs:
        if p["left"] not in taken and p["right"] not in taken:
            out.append(p)
            taken |= {p["left"], p["right"]}
            if len(out) == batch:
                break
    return out


def _matched(pairs: DataFrame, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """``left`` and ``right`` of at most ``batch`` pairs of disjoint symbols, chosen by executors until the driver can go on.

    A pair that is the best of both its symbols is taken, by frequency and then by a hash, so that
    chains of equal pairs are short. Pairs with a symbol that is taken are out. The driver goes on
    with the pairs that are left.
    """
    spark, paths, left, right = pairs.sparkSession, [], [], []
    rank = F.shiftleft(F.least("freq", F.lit((1 << 19) - 1)), 43) + F.xxhash64("left", "right").bitwiseAND(F.lit((1 << 43) - 2)) + (F.col("left") == F.col("right")).cast("long")
    rest, room = pairs.select("left", "right", "freq", rank.alias("rank")), batch

    def held(df: DataFrame) -> DataFrame:
        paths.append(table_path(spark, "matched"))
        return written(df, "matched", paths[-1])

    def take(pair: pa.Table) -> None:
        nonlocal room
        a, b = (pair.column(c).to_numpy() for c in ("left", "right"))
        left.append(a)
        right.append(b)
        room -= len(a)

    while (n := rest.count()) > GATHERED and room > 0:
        best = rest.select("rank", F.explode(F.array("left", "right")).alias("sym")).groupBy("sym").agg(F.max("rank").alias("rank"))
        both = best.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n = 2 OR n = 1 AND rank % 2 = 1").select("rank")
        taken = held(rest.join(both, "rank", "left_semi"))
        most = taken if taken.count() <= room else taken.orderBy(F.desc("freq"), "left", "right").limit(room)
        take(most.select("left", "right").toArrow().sort_by("left"))
        gone = taken.select(F.explode(F.array("left", "right")).alias("sym")).distinct()
        for end in ("left", "right"):
            rest = rest.join(gone.withColumnRenamed("sym", end), end, "left_anti")
        rest = held(rest.select("left", "right", "freq", "rank"))
    if n and room > 0:
        top = _disjoint(rest.select("left", "right", "freq").orderBy(F.desc("freq"), "left", "right").limit(GATHERED).collect(), room)
        take(pa.table({c: pa.array([p[c] for p in top], pa.int64()) for c in ("left", "right")}))
    for path in paths:
        drop_path(spark, path)
    left, right = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    # two pairs of one rank, should there be any, may share a symbol
    symbols, uses = np.unique(np.concatenate([left, right[right != left]]), return_counts=True)
    shared = symbols[uses > 1]
    alone = ~(np.isin(left, shared) | np.isin(right, shared))
    return (left, right) if alone.all() else (left[alone], right[alone])


def _repeated(pairs: DataFrame, n: int, since: int) -> Known:
    """A filter of ``n`` pairs; each executor's task makes whole parts of it."""
    size = min(max(PART * 8, 1 << (n * PAIR_BITS - 1).bit_length()), MOST_BITS)
    bits = np.zeros(size // 8, np.uint8)
    if n <= GATHERED:
        held = pairs.select("left", "right").toArrow()
        _set(bits, _places(held.column("left").to_numpy(), held.column("right").to_numpy(), since, size).ravel())
        return Known(bits, since)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column(0).to_numpy(), b.column(1).to_numpy(), since, size).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at // (PART * 8)), pa.array(at)], names=["part", "at"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, there = np.zeros(size // 8, np.uint8), np.zeros(size // (PART * 8), bool)
        for b in batches:
            there[b.column(0).to_numpy()] = True
            _set(own, b.column(1).to_numpy())
        some = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([own[k * PART : (k + 1) * PART].tobytes() for k in some], pa.binary())], names=["part", "bits"])

    made = pairs.select("left", "right").mapInArrow(places, "part long, at long").repartition("part").mapInArrow(parts, "part long, bits binary").toArrow()
    for k, part in zip(made.column("part").to_pylist(), made.column("bits").to_pylist(), strict=True):
        bits[k * PART : (k + 1) * PART] = np.frombuffer(part, np.uint8)
    return Known(bits, since)


def _replaced(segments: DataFrame, new: np.ndarray, number: int, known: Known | None) -> DataFrame:
    """Segments with the pairs of ``new(rule, left, right)`` replaced; a symbol is in one pair at most.

    ``round`` is ``number``, or -1 where nothing in a segment may repeat any more.
    """
    table = new[np.argsort(new[:, 1], kind="stable")]

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, left, right = np.ascontiguousarray(table.T)
        for b, symbols, cuts in _slices(batches):
            which = np.minimum(np.searchsorted(left, symbols), len(left) - 1)
            hit = _starts(symbols, cuts) & (left[which] == symbols)
            hit[:-1] &= right[which[:-1]] == symbols[1:]
            kept = np.ones(len(symbols), bool)
            kept[1:] = ~hit[:-1]
            out = np.where(hit, rule[which], symbols)[kept]
            ends = np.concatenate([[0], np.cumsum(kept)])[cuts]
            may = np.searchsorted(_candidates(out, ends, known), ends)
            state = np.where(np.diff(may) > 0, number, -1)
            syms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), syms, pa.array(state, pa.int64())], names=["id", "seg", "syms", "round"])

    return segments.mapInArrow(replaced, ROUNDS)


def _rounds(segments: DataFrame, choose: Callable[[DataFrame, Known | None], tuple[np.ndarray, Known | None]], max_rounds: int) -> tuple[DataFrame, str]:
    """Replace what ``choose`` picks until it picks nothing; a round's segments go when the next one's are written."""
    spark, known = segments.sparkSession, None
    path = table_path(spark, "segments")

    def held(df: DataFrame) -> DataFrame:
        df.write.mode("append").partitionBy("round").parquet(path)
        return spark.read.schema(ROUNDS).parquet(path)

    whole = held(segments.withColumn("round", F.lit(0).cast("long")))
    for k in range(max_rounds):
        segments = whole.filter(F.col("round") == k).select("id", "seg", "syms")
        new, known = choose(segments, known)
        if not len(new):
            break
        whole = held(_replaced(segments, new, k + 1, known))
        drop_path(spark, f"{path}/round={k}")
    return spark.read.schema(ROUNDS).parquet(path).select("id", "seg", "syms"), path


def repair(graph: Graph, batch: int = 1 << 20, max_rounds: int = 1000, min_gain: int = -1, segment: int = SEGMENT) -> CompressedGraph:
    """Compress ``graph``; ``batch`` bounds the pairs that a round accepts and tells all tasks.

    The driver holds those of one round, as arrays; the rules of a round are written as it ends.

    Stops when no pair occurs twice, when the best pair saves no more than ``min_gain``
    ((freq - 1) - 1), or after ``max_rounds``. The result is lossless in any case.
    """
    graph = graph.kept
    spark: SparkSession = graph.spark
    base, made = graph.meta.rule_base, 0
    rules = table_path(spark, "rules")
    schema = "id long, left long, right long"
    spark.createDataFrame([], schema).write.mode("append").parquet(rules)

    def choose(segments: DataFrame, known: Known | None) -> tuple[np.ndarray, Known | None]:
        nonlocal made
        live = _frequencies(segments, known).filter(F.col("freq") - 2 > min_gain)
        if batch * 4 <= GATHERED:
            top = live.orderBy(F.desc("freq"), "left", "right").limit(max(batch, 1) * (4 if batch > 1 else 1)).collect()
            chosen = _disjoint(top, batch)
            left, right = (np.array([p[c] for p in chosen], np.int64) for c in ("left", "right"))
        else:
            path = table_path(spark, "pairs")
            live = written(live, "pairs", path)
            n = live.count()
            left, right = _matched(live, batch)
            known = _repeated(live, n, base + made)
            drop_path(spark, path)
        new = np.stack([np.arange(len(left)) + base + made, left, right], axis=1)
        if len(new):
            made += len(new)
            spark.createDataFrame(pa.table(dict(zip(("id", "left", "right"), new.T, strict=True)))).coalesce(1).write.mode("append").parquet(rules)
        return new, known

    if "pos" in graph.edges.columns:
        strings, sorted_path = _segments(graph.symbols(segment)), None
    else:
        strings, sorted_path = _sorted_segments(graph.edges, segment)
    segments, path = _rounds(strings, choose, max_rounds)
    rows = segments.select("id", "seg", F.posexplode("syms").alias("pos", "sym")).withColumn("pos", F.col("pos").cast("long"))
    bodies = spark.read.schema(schema).parquet(rules).select("id", F.lit(0).cast("long").alias("seg"), F.posexplode(F.array("left", "right")).alias("pos", "sym"))
    strings = settled(rows.unionByName(bodies.withColumn("pos", F.col("pos").cast("long"))))
    for p in (path, rules, *([sorted_path] if sorted_path else [])):
        drop_path(spark, p)
    return CompressedGraph(strings, graph.vertices, graph.edges, GraphMeta(graph.meta.vertex_cnt, made, base))


def decompress(c: CompressedGraph, part: int = SEGMENT) -> Graph:
    """The original rows. Rules are expanded among themselves, in as many rounds as the logarithm of their
    depth, and cut into arrays of ``part`` vertices; a row takes them up in one join, as the rows are read.

    Places come from lengths, so no row of the original is sorted or gathered. A rule without a body stands
    for nothing.
    """
    rules = c.strings.filter(c.is_rule("id"))
    while not rules.filter(c.is_rule("sym")).isEmpty():
        inner = rules.select(F.col("id").alias("rule"), F.struct(F.col("seg").alias("rs"), F.col("pos").alias("rp")).alias("inner"), F.col("sym").alias("child"))
        rules = settled(expanded(rules, inner))
    at = F.row_number().over(Window.partitionBy("id").orderBy("seg", "pos")) - 1
    cut = rules.select(F.col("id").alias("rule"), at.alias("at"), "sym").groupBy("rule", F.floor(F.col("at") / part).alias("part"))
    parts = settled(cut.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "sym"))), lambda x: x["sym"]).alias("body")))
    sizes = parts.groupBy("rule").agg(F.sum(F.size("body")).alias("size"), F.count(F.lit(1)).alias("parts"))
    rows = c.strings.filter(~c.is_rule("id")).join(sizes, F.col("sym") == F.col("rule"), "left")
    rows = rows.select("id", "seg", "pos", "sym", "parts", F.coalesce("size", F.when(c.is_rule("sym"), 0).otherwise(1)).alias("size"))
    earlier = lambda *keys: Window.partitionBy("id", *keys).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("id", "seg").agg(F.sum("size").alias("size")).select("id", "seg", F.coalesce(F.sum("size").over(earlier().orderBy("seg")), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("size").over(earlier("seg").orderBy("pos")), F.lit(0))
    placed = rows.withColumn("own", own).join(before, ["id", "seg"]).select(F.col("id").alias("src"), "sym", "parts", (F.col("own") + F.col("before")).cast("long").alias("pos"))
    plain = placed.filter(~c.is_rule("sym")).select("src", F.col("sym").alias("dst"), "pos")
    uses = placed.filter("parts IS NOT NULL").select("src", "pos", F.col("sym").alias("rule"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    spelt = uses.join(parts, ["rule", "part"]).select("src", "pos", "part", F.posexplode("body").alias("k", "dst"))
    return Graph(plain.unionByName(spelt.select("src", "dst", (F.col("pos") + F.col("part") * part + F.col("k")).alias("pos"))), c.vertices)


def expanded(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """One round of replacing rule symbols by their bodies ``(rule, inner, child)``, in order."""
    order = Window.partitionBy("id", "seg").orderBy("pos", F.col("inner").asc_nulls_first())
    s = rows.join(rules, rows["sym"] == rules["rule"], "left")
    return s.select("id", "seg", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.coalesce("child", "sym").alias("sym"))
