"""Inlining rules that do not pay for themselves.

Whether a rule goes depends on how often it is used in the unpruned grammar and on its
length once its own inlined rules are spliced in. So decisions run bottom-up, one level
of nesting at a time, on counts; bodies are spliced afterwards, nested ones by doubling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.functions import indexed, rules_worth_inlining, rules_worth_inlining_decomposed
from lacewing.model import CompressedGraph, GraphMeta
from lacewing.operators.grammar import expanded
from lacewing.plans.propagate import iterate
from lacewing.session import settled


def _verdicts(c: CompressedGraph, inline: Callable[[Column, Column], Column]) -> DataFrame:
    """``(id, merged)`` of each rule, by counts alone: one small join a level of nesting."""
    used = settled(c.strings.filter(c.is_rule("sym")).groupBy(F.col("id").alias("src"), F.col("sym").alias("dst")).agg(F.count(F.lit(1)).alias("mult")))
    freq = used.groupBy(F.col("dst").alias("id")).agg(F.sum("mult").alias("freq"))
    bodies = c.strings.filter(c.is_rule("id"))
    plain = bodies.groupBy("id").agg(F.count_if(~c.is_rule("sym")).alias("plain"))
    between = settled(used.filter(c.is_rule("src")).select(F.col("src").alias("user"), F.col("dst").alias("id"), "mult"))
    state = plain.join(freq, "id", "left").select("id", "plain", F.coalesce("freq", F.lit(0)).alias("freq"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("boolean").alias("merged"))

    def step(state: DataFrame, _: int) -> DataFrame:
        spliced = F.col("mult") * F.when(F.col("merged"), F.col("length")).otherwise(1)
        inner = between.join(state.select("id", "length", "merged"), "id").groupBy(F.col("user").alias("id"))
        inner = inner.agg(F.sum(spliced).alias("inner"), F.bool_and(F.col("merged").isNotNull()).alias("known"))
        s = state.join(inner, "id", "left").withColumn("known", F.coalesce("known", F.lit(True)))
        s = s.withColumn("length", F.coalesce("length", F.when(F.col("known"), F.col("plain") + F.coalesce("inner", F.lit(0)))))
        return s.select("id", "plain", "freq", "length", F.when(F.col("known"), inline(F.col("length"), F.col("freq"))).alias("merged"))

    # Rules are acyclic, so each round decides one level more.
    state = iterate(state, step, lambda s, _: not s.filter("merged is null").isEmpty(), 1 << 62)
    return state.select("id", "merged")


def _bodies(strings: DataFrame) -> DataFrame:
    return strings.select(F.col("id").alias("rule"), F.struct(F.col("seg").alias("rs"), F.col("pos").alias("rp")).alias("inner"), F.col("sym").alias("child"))


def _pruned(c: CompressedGraph, inline: Callable[[Column, Column], Column]) -> CompressedGraph:
    if not c.meta.rule_cnt:
        return c
    verdicts = settled(_verdicts(c, inline))
    merged, kept = verdicts.filter("merged").select("id"), verdicts.filter("not merged").select("id")
    gone = c.strings.filter(c.is_rule("id")).join(merged, "id", "left_semi")
    while not gone.join(merged.withColumnRenamed("id", "sym"), "sym", "left_semi").isEmpty():
        gone = settled(expanded(gone, _bodies(gone)))
    numbers = settled(indexed(kept, ["id"]).select("id", (F.col("idx") + c.meta.rule_base).alias("new")))
    # symbols of rows that aren't rules stay as they are: only the others are joined
    plain = ~c.is_rule("id") & ~c.is_rule("sym")
    ruled, at = c.strings.filter(~plain).join(merged, "id", "left_anti"), F.col("pos")
    most, far = gone.groupBy("id").count().agg(F.max("count")).first()[0] or 1, c.strings.agg(F.max(F.abs("pos"))).first()[0] or 0
    if (far + 1) * most < 1 << 62:
        at = at * F.lit(most)
        inner = F.row_number().over(Window.partitionBy("id").orderBy("seg", "pos")) - 1
        bodies = gone.select(F.col("id").alias("rule"), F.col("sym").alias("child"), inner.alias("inner"))
        spliced = ruled.join(bodies, F.col("sym") == F.col("rule"), "left")
        ruled = spliced.select("id", "seg", (at + F.coalesce("inner", F.lit(0))).cast("long").alias("pos"), F.coalesce("child", "sym").alias("sym"))
        kept_rows = c.strings.filter(plain).select("id", "seg", at.cast("long").alias("pos"), "sym")
        strings = kept_rows.unionByName(_renumbered(_renumbered(ruled, numbers, "id"), numbers, "sym"))
    else:
        # places would not fit: all rows are numbered anew
        strings = expanded(c.strings.join(merged, "id", "left_anti"), _bodies(gone))
        strings = _renumbered(_renumbered(strings, numbers, "id"), numbers, "sym")
    return CompressedGraph(settled(strings), c.vertices, c.edges, GraphMeta(c.meta.vertex_cnt, numbers.count(), c.meta.rule_base), schedule=c.schedule)


def _renumbered(strings: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    out = strings.join(numbers.select(F.col("id").alias(column), "new"), column, "left")
    return out.withColumn(column, F.coalesce("new", column)).select("id", "seg", "pos", "sym")


def filter_rules(c: CompressedGraph, threshold: int = 16) -> CompressedGraph:
    """Inline rules with (freq - 1) * (length - 1) - 1 <= threshold; the rest are numbered anew."""
    return _pruned(c, lambda length, freq: rules_worth_inlining(length, freq, threshold))


def filter_rules_decomposed(c: CompressedGraph, min_freq: int = 4, min_length: int = 4, mode: str = "and") -> CompressedGraph:
    """Inline rules that are shorter than ``min_length`` and (or, by ``mode``) rarer than ``min_freq``."""
    return _pruned(c, lambda length, freq: rules_worth_inlining_decomposed(length, freq, min_freq, min_length, mode))


def flatten_rules(c: CompressedGraph) -> CompressedGraph:
    """The same rules, with rules inside rule bodies expanded: every rule is at one level."""
    bodies = c.strings.filter(c.is_rule("id"))
    while not bodies.filter(c.is_rule("sym")).isEmpty():
        bodies = settled(expanded(bodies, _bodies(bodies)))
    used = c.strings.filter(~c.is_rule("id")).filter(c.is_rule("sym")).select(F.col("sym").alias("id")).distinct()
    bodies = bodies.join(used, "id", "left_semi")
    strings = settled(c.strings.filter(~c.is_rule("id")).unionByName(bodies))
    return CompressedGraph(strings, c.vertices, c.edges, GraphMeta(c.meta.vertex_cnt, used.count(), c.meta.rule_base), schedule=c.schedule)


def rule_statistics(c: CompressedGraph) -> DataFrame:
    """``(id, freq, length)`` of each rule."""
    freq = c.strings.filter(c.is_rule("sym")).groupBy(F.col("sym").alias("id")).agg(F.count(F.lit(1)).alias("freq"))
    length = c.strings.filter(c.is_rule("id")).groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    return length.join(freq, "id", "left").select("id", F.coalesce("freq", F.lit(0)).alias("freq"), "length")
