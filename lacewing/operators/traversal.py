"""Breadth-first search, shortest paths, components and topological levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.model import CompressedGraph, Graph
from lacewing.plans.propagate import VertexProgram, iterate, kept, push, run_program
from lacewing.session import drop_path, table_path, written


def _root(graph: Graph | CompressedGraph, root: int) -> DataFrame:
    return graph.vertices.filter(F.col("id") == root)


def bfs(graph: Graph | CompressedGraph, root: int) -> DataFrame:
    """``(id, level, parent)`` of every vertex: hops from ``root``, and the least id one hop nearer.

    The root is its own parent; vertices out of reach have nulls. An unknown root reaches nothing.
    """
    state = "struct<level:long,parent:long>"
    program = VertexProgram(
        init=lambda g: _root(g, root).select("id", F.struct(F.lit(0).cast("long").alias("level"), F.col("id").alias("parent")).cast(state).alias("val")),
        message=lambda id, val, _: F.struct((val["level"] + 1).alias("level"), id.alias("parent")).cast(state),
    )
    graph = kept(graph)
    found = run_program(graph, program)
    return graph.vertices.join(found, "id", "left").select("id", F.col("val.level").alias("level"), F.col("val.parent").alias("parent"))


def bfs_compressed(c: CompressedGraph, root: int) -> DataFrame:
    """``(id, parent)`` over vertices and rules alike: a rule hop counts as a hop.

    The tree spans what ``root`` reaches but is no shortest-path tree of the original
    graph; the least parent of a round wins.
    """
    rules = c.strings.filter(c.is_rule("id")).select("id").distinct()
    flat = Graph(c.strings.select(F.col("id").alias("src"), F.col("sym").alias("dst")), c.vertices.unionByName(rules))
    return bfs(flat, root).select("id", "parent")


def sssp(graph: Graph | CompressedGraph, root: int, weighted: bool = False) -> DataFrame:
    """``(id, dist)``: fewest hops, or least total ``weight``; null out of reach.

    Weights must not form a negative cycle within reach of the root: that raises.
    """
    kind = "double" if weighted else "long"
    program = VertexProgram(
        init=lambda g: _root(g, root).select("id", F.lit(0).cast(kind).alias("val")),
        message=lambda _, val, weight: (val + weight).cast(kind),
        weighted=weighted,
    )
    graph = kept(graph)
    try:
        # hops can't go on for ever; weights can, and then for more rounds than there are vertices
        found = run_program(graph, program, max_iter=graph.meta.vertex_cnt + 1 if weighted else 1 << 62)
    except RuntimeError as e:
        raise ValueError("a negative cycle is within reach of the root") from e
    return graph.vertices.join(found, "id", "left").select("id", F.col("val").alias("dist"))


def cc_directed(graph: Graph | CompressedGraph) -> DataFrame:
    """``(id, label)``: the least id among a vertex and all that reach it along edges."""
    program = VertexProgram(init=lambda g: g.vertices.select("id", F.col("id").alias("val")), message=lambda _, val, __: val)
    return run_program(kept(graph), program).select("id", F.col("val").alias("label"))


def wcc(graph: Graph | CompressedGraph) -> DataFrame:
    """``(id, label)``: weakly connected components, named by their least id.

    Alternates hooking (each vertex offers its label to all neighbours' labels, along edges
    and against them) and pointer jumping, so rounds grow with the logarithm of the longest
    path. On a compressed graph labels pass through rules both ways.
    """
    graph = kept(graph)
    start = graph.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("changed"))
    paths: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        paths.append(table_path(df.sparkSession, tag))
        return written(df, tag, paths[-1])

    def step(state: DataFrame, _: int) -> DataFrame:
        while paths:
            drop_path(state.sparkSession, paths.pop())
        label = state.select("id", "label")
        offers = push(graph, label, {"label": "min"}).unionByName(push(graph, label, {"label": "min"}, reverse=True))
        near = offers.groupBy(F.col("id").alias("at")).agg(F.min("label").alias("near"))
        hooked = held(label.join(near, label["id"] == near["at"], "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new")), "hooked")
        # the old root of a hooked vertex follows it; a table, as a large component's label is a hot
        # key, and adaptive joins split one only where no aggregation lies between shuffle and join
        roots = held(hooked.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("to")), "roots")
        jumped = hooked.join(roots.withColumnRenamed("root", "r2"), F.col("new") == F.col("r2"), "left")
        lowered = F.least("new", F.coalesce("to", "new"))
        own = roots.withColumnsRenamed({"root": "r3", "to": "to3"})
        out = jumped.select("id", "label", lowered.alias("new")).join(own, F.col("label") == F.col("r3"), "left")
        final = F.least("new", F.coalesce("to3", "new"))
        return out.select("id", final.alias("label"), (final < F.col("label")).alias("changed"))

    state = iterate(start, step, lambda s, _: not s.filter("changed").isEmpty(), 1 << 62)
    for path in paths:
        drop_path(graph.spark, path)
    return state.select("id", "label")


def topo_levels(graph: Graph | CompressedGraph) -> DataFrame:
    """``(id, level)``: the longest path from a vertex without in-edges; null on or behind a cycle.

    A vertex is released once all its in-edges have delivered, so each edge is used once.
    A round rewrites the vertices that have some of their messages, not all vertices.
    """
    graph = kept(graph)
    spark, paths = graph.spark, []

    def held(df: DataFrame) -> DataFrame:
        paths.append(table_path(spark, "levels"))
        return written(df, "levels", paths[-1])

    degrees = held(graph.in_degrees().filter("in_degree > 0").select(F.col("id").alias("to"), "in_degree"))
    fresh = held(graph.vertices.join(degrees, F.col("id") == F.col("to"), "left_anti").select("id", F.lit(0).cast("long").alias("level")))
    released, partial, last = [fresh], None, None
    while not fresh.isEmpty():
        sent = push(graph, fresh.select("id", F.lit(1).cast("long").alias("got"), F.col("level").alias("above")), {"got": "sum", "above": "max"})
        if partial is not None:
            sent = sent.unionByName(partial).groupBy("id").agg(F.sum("got").alias("got"), F.max("above").alias("above"))
        path = table_path(spark, "partial")
        told = written(sent.join(degrees, F.col("id") == F.col("to")).select("id", "got", "above", "in_degree"), "partial", path)
        partial = told.filter("got < in_degree").select("id", "got", "above")
        fresh = held(told.filter("got = in_degree").select("id", (F.col("above") + 1).alias("level")))
        if last:
            drop_path(spark, last)
        last = path
        released.append(fresh)
        if len(released) > 16:
            released = [held(_union(released[:-1])), fresh]
    out = written(graph.vertices.join(_union(released), "id", "left").select("id", "level"), "levels")
    for p in [*paths, *([last] if last else [])]:
        drop_path(spark, p)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
