"""Top-down levels of rules: the schedule by which partial results pass through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.model import CompressedGraph
from lacewing.plans.propagate import iterate


def rule_levels(c: CompressedGraph) -> DataFrame:
    """``(id, level)``: 0 if only vertices use a rule, else one more than its deepest user.

    A rule that nothing uses has a null level. Rules are acyclic, so a round settles a level.
    """
    uses = c.strings.filter(c.is_rule("sym")).select(F.col("id").alias("user"), F.col("sym").alias("id")).distinct()
    between = uses.filter(c.is_rule("user"))
    rules = c.strings.filter(c.is_rule("id")).select("id").distinct()
    start = rules.join(uses.select("id").distinct().withColumn("used", F.lit(True)), "id", "left")
    start = start.select("id", F.when(F.col("used"), F.lit(0)).alias("level"), F.coalesce("used", F.lit(False)).alias("changed"))

    def step(state: DataFrame, _: int) -> DataFrame:
        told = between.join(state.filter("changed").select(F.col("id").alias("user"), F.col("level").alias("above")), "user")
        told = told.groupBy("id").agg((F.max("above") + 1).alias("new"))
        out = state.join(told, "id", "left")
        grew = F.coalesce(F.col("new") > F.col("level"), F.lit(False))
        return out.select("id", F.when(grew, F.col("new")).otherwise(F.col("level")).alias("level"), grew.alias("changed"))

    return iterate(start, step, lambda s, _: not s.filter("changed").isEmpty(), 1 << 62).select("id", "level")
