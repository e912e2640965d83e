"""Connected components by alternating large-star and small-star on edge tables.

A node with a large share of the edges would be one task in the joins with the least
neighbours, as an aggregation stands before them and adaptive joins don't split those.
So the least neighbours of such hubs, ``HUBS`` at most, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.session import drop_path, recording, settled

#: A node with more than this share of the rows is a hub: so many at most.
HUBS = 1000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(near: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``(u, v, m)``: the rows ``near(u, v)`` with ``m`` of ``least(u, m, n)``, which counts them; ``rows`` in all."""
    hub = F.col("n") > F.lit(max(rows // HUBS, 1))
    hubs, others = F.broadcast(least.filter(hub).select("u", "m")), least.filter(~hub).select("u", "m")
    return near.join(hubs, "u").unionByName(near.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Larger neighbours of each node are linked to the least node around it; ``edges`` has ``rows`` rows."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _with_least(near, least, 2 * rows).filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those; ``edges`` has ``rows`` rows."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    lower = _with_least(down, least, rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` of every node with an edge in ``edges(u, v)``: the least node reachable.

    Each round is two joins; rounds grow with the logarithm squared of the graph at most. A
    round's tables go when the next one has written its own. Null ends and loops are ignored;
    an empty table gives no rows.
    """
    with recording() as made:
        edges = settled(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u != v").distinct())
        mark, rows = None, edges.count()
        for _ in range(max_rounds):
            large = settled(large_star(edges, rows))
            edges = settled(small_star(large, large.count()))
            for path in made[:-1]:
                drop_path(edges.sparkSession, path)
            del made[:-1]
            # a star forest is a fixpoint: the same edges after a round
            now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == mark:
                break
            mark, rows = now, now[0]
        else:
            raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
