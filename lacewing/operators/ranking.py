"""PageRank and hubs/authorities, on plain and compressed graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.model import CompressedGraph, Graph
from lacewing.plans.propagate import RoundProgram, kept, run_rounds


def pagerank(graph: Graph | CompressedGraph, damping: float = 0.85, max_iter: int = 10, eps: float | None = 1e-7, teleport: str = "V", dangling: str = "drop", stop: str = "l1") -> DataFrame:
    """``(id, rank)`` after ``max_iter`` rounds, or once the change is under ``eps``.

    ``teleport`` spreads the jump over the vertices (``V``) or over vertices and rules
    (``V+R``, whose ranks then depend on the grammar). ``dangling`` mass is dropped or
    spread uniformly. ``stop`` measures the change by ``l1`` or ``linf``; ``eps=None``
    runs all rounds.
    """
    if teleport not in ("V", "V+R") or dangling not in ("drop", "uniform") or stop not in ("l1", "linf"):
        raise ValueError("unknown option")
    graph = kept(graph)
    n = graph.meta.vertex_cnt
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"))
    spread = n + (graph.meta.rule_cnt if teleport == "V+R" else 0)

    def apply(joined: DataFrame, state: DataFrame) -> DataFrame:
        lost = 0.0
        if dangling == "uniform":
            lost = state.filter("out_degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        rank = F.lit(damping) * F.coalesce("share", F.lit(0.0)) + F.lit((1 - damping) / spread + damping * lost / spread)
        return joined.select("id", "out_degree", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))

    measure = F.sum if stop == "l1" else F.max
    program = RoundProgram(
        init=lambda g: g.out_degrees().select("id", "out_degree", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")),
        send=lambda: {"share": F.col("rank") / F.col("out_degree")},
        combine={"share": "sum"},
        apply=apply,
        unfinished=lambda s: eps is None or s.agg(measure("change")).first()[0] >= eps,
        active=F.col("out_degree") > 0,
    )
    return run_rounds(graph, program, max_iter).select("id", "rank")


def hits(graph: Graph | CompressedGraph, max_iter: int = 10, norm: str = "l2", naming: str = "standard") -> DataFrame:
    """``(id, hub, authority)`` after ``max_iter`` simultaneous rounds.

    ``norm`` divides by the root of the sum of squares (``l2``) or the sum itself
    (``sumsq``). By ``naming="standard"`` authority gathers over in-edges; by
    ``"reference"`` the two names are swapped.
    """
    if norm not in ("l2", "sumsq") or naming not in ("standard", "reference"):
        raise ValueError("unknown option")
    by = {"hub": 1.0, "authority": 1.0}  # the norms that the state is still to be divided by

    def norms(state: DataFrame) -> bool:
        for name, x in zip(by, state.agg(*[F.sum(F.col(c) * F.col(c)) for c in by]).first(), strict=True):
            by[name] = (math.sqrt(x or 0.0) if norm == "l2" else x) or 1.0
        return True

    part = lambda c: F.col(c) / F.lit(by[c])
    program = RoundProgram(
        init=lambda g: g.vertices.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")),
        send=lambda: {"in": part("hub")},
        against=lambda: {"out": part("authority")},
        combine={"in": "sum", "out": "sum"},
        apply=lambda joined, _: joined.select("id", F.coalesce("out", F.lit(0.0)).alias("hub"), F.coalesce("in", F.lit(0.0)).alias("authority")),
        unfinished=norms,
    )
    out = run_rounds(kept(graph), program, max_iter)
    out = out.select("id", part("hub").alias("hub"), part("authority").alias("authority"))
    if naming == "reference":
        out = out.select("id", F.col("authority").alias("hub"), F.col("hub").alias("authority"))
    return out.select("id", "hub", "authority")


def hits_top(scores: DataFrame, k: int, by: str = "authority") -> DataFrame:
    """The ``k`` best vertices; ties go to the lesser id."""
    return scores.orderBy(F.desc(by), "id").limit(k)
