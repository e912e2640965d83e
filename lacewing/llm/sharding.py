"""Shards of near equal size by best-fit-decreasing packing of indivisible groups.

Equal texts are one group. A group with more than 1/bundles of all bytes is an item by
itself; the others are tied by the hash of their text into at most ``bundles`` items.
So the driver packs at most 2 * ``bundles`` items whatever the corpus holds, and the
two tables that it broadcasts have at most ``bundles`` rows each.

With a fixed capacity, groups are dealt by hash to ranges of some ``RANGE`` shards, which
are packed apart from each other by the executors: again by bundles of about 1/64 of a
shard, and larger groups by themselves. A bundle that outgrows 1/8 of a shard is taken
apart. The driver gets the number of shards of each range.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacewing.session import written

#: Bound on the items of either kind.
BUNDLES = 8192
#: Shards of a range that is packed by itself, about.
RANGE = 128
#: Rows of one shard are numbered in so many independent parts.
PARTS = 256


class BestFitTree:
    """A balanced search tree (AA tree) of bins by remaining capacity, then by number."""

    def __init__(self) -> None:
        self.root: list | None = None  # a node is [key, level, left, right]

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def delete(self, key: tuple[int, int]) -> None:
        self.root = self._delete(self.root, key)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The key with the least remaining capacity >= ``need``."""
        node, best = self.root, None
        while node:
            if node[0][0] >= need:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    @staticmethod
    def _skew(t: list) -> list:
        left = t[2]
        if left and left[1] == t[1]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t: list) -> list:
        right = t[3]
        if right and right[3] and right[3][1] == t[1]:
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def _insert(self, t: list | None, key: tuple[int, int]) -> list:
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._insert(t[side], key)
        return self._split(self._skew(t))

    def _delete(self, t: list | None, key: tuple[int, int]) -> list | None:
        if t is None:
            return None
        if key != t[0]:
            side = 2 if key < t[0] else 3
            t[side] = self._delete(t[side], key)
        elif t[2] is None:
            return t[3]
        elif t[3] is None:
            return t[2]
        else:
            least = t[3]
            while least[2]:
                least = least[2]
            t[0] = least[0]
            t[3] = self._delete(t[3], least[0])
        low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if low < t[1]:
            t[1] = low
            if t[3] and low < t[3][1]:
                t[3][1] = low
        t = self._skew(t)
        if t[3]:
            t[3] = self._skew(t[3])
            if t[3][3]:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3]:
            t[3] = self._split(t[3])
        return t


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each item: largest first, each into the fullest bin that still takes it.

    With ``bins`` that many are open from the start and None says that they don't
    suffice; without, a new bin opens when none fits, an item over ``capacity`` alone in one.
    """
    sizes = list(sizes)
    tree, out, opened = BestFitTree(), [0] * len(sizes), bins or 0
    for b in range(opened):
        tree.insert((capacity, b))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found:
            tree.delete(found)
        elif bins is not None:
            return None
        else:
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        out[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return out


def equal_bins(sizes: list[int], bins: int, rounds: int = 10) -> list[int]:
    """Best fit into ``bins`` bins at the least capacity that bisection finds to suffice."""
    low = max([-(-sum(sizes) // bins), *sizes]) if sizes else 1
    high, best = low, best_fit_decreasing(sizes, low, bins)
    while best is None:
        low, high = high, high + max(sizes)
        best = best_fit_decreasing(sizes, high, bins)
    for _ in range(rounds):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, bins)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    return best


def packed_ranges(groups: DataFrame, total: int, capacity: int, bundles: int) -> DataFrame:
    """``(key, shard)`` for ``groups(key, total)``, with no shard over ``capacity`` but for a group that is.

    A range has at most 64 * ``RANGE`` groups over 1/64 of a shard, ``bundles`` bundles, and 8 * ``RANGE``
    bundles taken apart, about; it leaves one shard partly filled.
    """
    spark, ranges = groups.sparkSession, -(-total // (RANGE * capacity))
    spread = F.xxhash64("key", F.lit("range"))
    item = groups.withColumn("range", F.pmod(spread, F.lit(ranges)).cast("long")).withColumn("bundle", F.pmod("key", F.lit(bundles)).cast("long"))
    alone = F.col("total") > capacity // 64
    light = item.filter(~alone)
    tied = light.groupBy("range", "bundle").agg(F.sum("total").alias("total"))
    large = F.col("total") > capacity // 8
    loose = light.join(tied.filter(large).select("range", "bundle"), ["range", "bundle"], "left_semi")
    none = F.lit(None).cast("long")
    items = item.filter(alone).select("range", "key", none.alias("bundle"), "total")
    items = items.unionByName(loose.select("range", "key", none.alias("bundle"), "total")).unionByName(tied.filter(~large).select("range", none.alias("key"), "bundle", "total"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.select(["range", "key", "bundle", "total"]).sort_by([("key", "ascending"), ("bundle", "ascending")])
        bins = best_fit_decreasing(table["total"].to_pylist(), capacity)
        return table.select(["range", "key", "bundle"]).append_column("bin", pa.array(bins, pa.int64()))

    bins = written(items.groupBy("range").applyInArrow(pack, "range long, key long, bundle long, bin long"), "bins")
    before, first = 0, []
    for r in bins.groupBy("range").agg(F.max("bin").alias("last")).orderBy("range").collect():
        first.append((r["range"], before))
        before += r["last"] + 1
    offsets = spark.createDataFrame(first, "range long, first long")
    bins = bins.join(F.broadcast(offsets), "range").withColumn("shard", (F.col("first") + F.col("bin")).cast("int"))
    by_key, by_bundle = bins.filter("key IS NOT NULL").select("key", F.col("shard").alias("own")), bins.filter("key IS NULL").select("range", "bundle", F.col("shard").alias("tied"))
    return item.join(by_key, "key", "left").join(by_bundle, ["range", "bundle"], "left").select("key", F.coalesce("own", "tied").alias("shard"))


def shard_documents(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, bundles: int = BUNDLES, parts: int = PARTS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: ``shards`` near equal ones, or as few as hold ``capacity`` bytes each.

    A row's size is its text's bytes plus 1; equal texts share a shard, null counts as
    empty. ``slot`` numbers the rows of a shard from 0 by part, then ``doc_id`` (nulls
    first). Repeated rows are kept each. A group larger than a shard fills one alone.
    "As few" is by best fit within ranges of about ``RANGE`` shards.
    Very long texts are measured whole. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("total")), "groups")
    total = groups.agg(F.sum("total")).first()[0] or 0
    if capacity and total:
        placed = rows.join(packed_ranges(groups, total, capacity, bundles), "key")
    else:
        placed = _near_equal(rows, groups, total, shards, bundles)
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    return numbered(placed, "shard", "part", ["doc_id", "size", "text_crc32"], "slot").drop("part")


def _near_equal(rows: DataFrame, groups: DataFrame, total: int, shards: int | None, bundles: int) -> DataFrame:
    """``rows`` with their ``shard`` of ``shards`` near equal ones."""
    least = total // bundles
    heavy = groups.filter(F.col("total") > least).collect()  # at most `bundles` rows
    bundle = F.pmod("key", F.lit(bundles)).cast("int")
    light = groups.filter(F.col("total") <= least).groupBy(bundle.alias("bundle")).agg(F.sum("total").alias("total")).collect()
    sizes = [r["total"] for r in (*heavy, *light)]
    bins = equal_bins(sizes, shards)
    spark = rows.sparkSession
    by_key = spark.createDataFrame([(r["key"], b) for r, b in zip(heavy, bins, strict=False)], "key long, own int")
    by_bundle = spark.createDataFrame([(r["bundle"], b) for r, b in zip(light, bins[len(heavy) :], strict=True)], "bundle int, tied int")
    return rows.join(F.broadcast(by_key), "key", "left").withColumn("bundle", bundle).join(F.broadcast(by_bundle), "bundle", "left").withColumn("shard", F.coalesce("own", "tied"))


def numbered(rows: DataFrame, key: str, part: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers within each ``key``: by ``part``, then ``order``; no task holds a whole key.

    The table of part sizes has as many rows as there are pairs of key and part.
    """
    sizes = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, part).orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(offsets, [key, part]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before")
