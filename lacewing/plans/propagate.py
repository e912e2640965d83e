"""Propagation along edges: the loop that all vertex programs share.

``push`` sends values one hop along original edges. On a compressed graph a hop may
pass through rules; that is free, so the answer for vertices is that of the plain graph.
By the graph's schedule, values pass through rules in one further join with the vertices that
rules stand for, or level by level, one join for each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacewing.model import CompressedGraph, Graph
from lacewing.session import drop_path, table_path, written

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def kept(graph: Graph | CompressedGraph) -> Graph | CompressedGraph:
    """A graph whose tables are written: loops read them in each round."""
    return graph.kept if isinstance(graph, Graph) else graph


def _sent(values: DataFrame, links: DataFrame, aggs: dict[str, str], source: str, target: str, how: str = "inner") -> DataFrame:
    """A message per link; with ``how="left"`` a value that no link takes on is its own message."""
    links = links.select(F.col(source).alias("link_from"), F.col(target).alias("link_to"), "mult")
    times = F.coalesce("mult", F.lit(1))
    cols = [(F.col(c) * times if kind == "sum" else F.col(c)).alias(c) for c, kind in aggs.items()]
    return values.join(links, F.col("id") == F.col("link_from"), how).select(F.coalesce("link_to", "id").alias("to"), *cols)


def push(graph: Graph | CompressedGraph, values: DataFrame, aggs: dict[str, str], reverse: bool = False) -> DataFrame:
    """Send ``values(id, ...)`` along out-edges (or in-edges) and combine them per receiver.

    ``aggs`` maps each value column to ``sum``, ``min`` or ``max``. A sum counts equal
    edges as often as they occur. Receivers without a message have no row.
    """
    source, target = ("dst", "src") if reverse else ("src", "dst")

    def combined(sent: DataFrame) -> DataFrame:
        return sent.groupBy(F.col("to").alias("id")).agg(*[AGGREGATES[how](c).alias(c) for c, how in aggs.items()])

    if isinstance(graph, Graph):
        return combined(_sent(values, graph.links, aggs, source, target))
    values = values.select("id", *aggs)
    if graph.schedule == "levels":
        return _by_levels(graph, values, aggs, reverse, combined)
    if not reverse:
        return combined(_sent(combined(_sent(values, graph.links, aggs, source, target)), graph.rule_links, aggs, source, target, "left"))
    through = combined(_sent(values, graph.rule_links, aggs, source, target))
    return combined(_sent(values.unionByName(through), graph.links, aggs, source, target))


def _by_levels(graph: CompressedGraph, values: DataFrame, aggs: dict[str, str], reverse: bool, combined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``push`` through rules in the order of their levels: a rule's value is complete before it is passed on.

    Downwards a rule has what the rows and the rules above it have sent; upwards, what its
    body holds. Each level is one join with the bodies of that level.
    """
    links, source, target = graph.level_links, *(("dst", "src") if reverse else ("src", "dst"))
    as_values = lambda df: df.withColumnRenamed("to", "id")
    if reverse:
        known = values
        for level in range(graph.max_level, -1, -1):
            known = known.unionByName(combined(_sent(known, links.filter(F.col("level") == level), aggs, source, target)))
        return combined(_sent(known, graph.links, aggs, source, target))
    first = as_values(_sent(values, graph.links, aggs, source, target))
    done, waiting = [first.filter(~graph.is_rule("id"))], first.filter(graph.is_rule("id"))
    for level in range(graph.max_level + 1):
        waiting = combined(waiting.withColumnRenamed("id", "to"))
        sent = as_values(_sent(waiting, links.filter(F.col("level") == level), aggs, source, target))
        done.append(sent.filter(~graph.is_rule("id")))
        waiting = waiting.unionByName(sent.filter(graph.is_rule("id")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return combined(out.withColumnRenamed("id", "to"))


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], unfinished: Callable[[DataFrame, int], bool], max_iter: int, settles: bool = True) -> DataFrame:
    """Apply ``step`` until ``unfinished`` is false, with a table in the shared folder after each.

    The table of the round before is deleted. To be still unfinished after ``max_iter`` rounds is
    an error, unless ``settles`` is false: then that many rounds are all that was asked for.
    """
    spark, last = state.sparkSession, None
    for i in range(max_iter):
        path = table_path(spark, "state")
        state = written(step(state, i), "state", path)
        if last:
            drop_path(spark, last)
        last = path
        if not unfinished(state, i):
            return state
    if settles:
        raise RuntimeError(f"not settled after {max_iter} rounds")
    return state


@dataclass(frozen=True)
class VertexProgram:
    """A monotone program: a vertex holds ``val`` and takes the best message it gets.

    ``init(graph)`` gives ``(id, val)`` for the vertices that start with a value;
    ``message(id, val, weight)`` is the column sent along each edge; ``combine`` is
    ``min`` or ``max``. With ``weighted`` the edge table's weight reaches the message
    (plain graphs only, as a rule merges edges of different weight).
    """

    init: Callable[[Graph | CompressedGraph], DataFrame]
    message: Callable[[Column, Column, Column], Column]
    combine: str = "min"
    weighted: bool = False


#: Tables of changes that a program reads besides each other before they are made one.
DELTAS = 8


def run_program(graph: Graph | CompressedGraph, program: VertexProgram, max_iter: int = 1_000_000) -> DataFrame:
    """Semi-naive fixpoint: only vertices whose value changed send in the next round.

    A round writes the values that got better, and no others. All values are the best of what
    the rounds wrote, made one table now and then; a message is dropped if there is one as good.
    To be unsettled after ``max_iter`` rounds is an error.
    """
    best, spark = AGGREGATES[program.combine], graph.spark
    if program.weighted and not (isinstance(graph, Graph) and "weight" in graph.edges.columns):
        raise ValueError("weights need a plain graph with a weight column")

    def held(df: DataFrame) -> DataFrame:
        paths.append(table_path(spark, "values"))
        return written(df, "values", paths[-1])

    def sent(active: DataFrame) -> DataFrame:
        if not program.weighted:
            return push(graph, active.select("id", program.message(F.col("id"), F.col("val"), F.lit(1)).alias("val")), {"val": program.combine})
        along = active.join(graph.links, active["id"] == graph.links["src"])
        out = along.select(F.col("dst").alias("id"), program.message(F.col("id"), F.col("val"), F.col("weight")).alias("val"))
        return out.groupBy("id").agg(best("val").alias("val"))

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    paths: list[str] = []
    deltas = [held(program.init(graph).select("id", "val"))]
    for _ in range(max_iter):
        known = union(deltas).select(F.col("id").alias("known_id"), F.col("val").alias("known"))
        as_good = F.col("known") <= F.col("val") if program.combine == "min" else F.col("known") >= F.col("val")
        new = held(sent(deltas[-1]).filter("val IS NOT NULL").join(known, (F.col("id") == F.col("known_id")) & as_good, "left_anti"))
        if new.isEmpty():
            break
        deltas.append(new)
        if len(deltas) > DELTAS:
            one = held(union(deltas).groupBy("id").agg(best("val").alias("val")))
            for old in paths[:-2]:
                drop_path(spark, old)
            # the last changes are still what sends
            paths, deltas = paths[-2:], [one, new]
    else:
        raise RuntimeError(f"not settled after {max_iter} rounds")
    out = written(union(deltas).groupBy("id").agg(best("val").alias("val")), "values")
    for old in paths:
        drop_path(spark, old)
    return out


@dataclass(frozen=True)
class RoundProgram:
    """A program in rounds over all vertices, with any state: ``(id, ...)`` as ``init`` makes it anew for each run.

    In a round the vertices that satisfy ``active`` send ``send()``, named columns of their state,
    along edges, and ``against()`` against them; a receiver combines them by ``combine`` (``sum``,
    ``min`` or ``max`` by name). ``apply(joined, state)`` gives the next state from the old one
    beside what came in (null without a message), and ``unfinished(state)`` says whether to go on.
    """

    init: Callable[[Graph | CompressedGraph], DataFrame]
    send: Callable[[], dict[str, Column]]
    combine: dict[str, str]
    apply: Callable[[DataFrame, DataFrame], DataFrame]
    unfinished: Callable[[DataFrame], bool] = lambda _: True
    against: Callable[[], dict[str, Column]] = dict
    active: Column | None = None


def run_rounds(graph: Graph | CompressedGraph, program: RoundProgram, max_iter: int, settles: bool = False) -> DataFrame:
    """The state after ``max_iter`` rounds, or once it isn't unfinished; see ``iterate``."""

    def step(state: DataFrame, _: int) -> DataFrame:
        senders = state if program.active is None else state.filter(program.active)
        joined = state
        for reverse, columns in ((False, program.send()), (True, program.against())):
            if columns:
                sent = senders.select("id", *[c.alias(name) for name, c in columns.items()])
                joined = joined.join(push(graph, sent, {name: program.combine[name] for name in columns}, reverse), "id", "left")
        return program.apply(joined, state)

    return iterate(program.init(graph), step, lambda s, _: program.unfinished(s), max_iter, settles)


def vertex_subset(graph: Graph | CompressedGraph, *ids: int, where: Column | None = None) -> DataFrame:
    """A frontier: the named vertices, those that satisfy ``where``, or all."""
    out = graph.vertices
    if ids:
        out = out.filter(F.col("id").isin(list(ids)))
    return out if where is None else out.filter(where)


def vertex_map(frontier: DataFrame, **columns: Column) -> DataFrame:
    """A function of each vertex of a frontier, as columns."""
    return frontier.withColumns(columns)


def edge_map(graph: Graph | CompressedGraph, frontier: DataFrame, aggs: dict[str, str], state: DataFrame | None = None) -> DataFrame:
    """Messages of a frontier; with ``state`` only to vertices that are not in it yet."""
    sent = push(graph, frontier, aggs)
    return sent if state is None else sent.join(state.select("id"), "id", "left_anti")
