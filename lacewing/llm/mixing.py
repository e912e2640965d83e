"""Mixing sources to target weights by Poisson replication.

DataFrame functions only. Each document is repeated as often as a Poisson variable says
whose mean is the repetition that takes its source to its weight. The variable is the
inverse of the distribution at a number hashed from the seed and the document's id, so a
rerun, in any partitioning, makes the same copies. Copies are then dealt out and ordered
by another hash: a shuffle of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacewing.functions import indexed
from lacewing.llm.common import free_name, let
from lacewing.session import written

#: Sources whose rates are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A mean over this is drawn as a sum of equal independent parts.
LARGEST_MEAN = 64
BITS = 52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons; 52 bits."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None, source: str = "source") -> DataFrame:
    """``(source, size, rate)``: how often a source is repeated on average.

    A source's size is its rows' UTF-8 bytes, plus 1 each. ``weights`` gives shares of the
    mixture (scaled to 1; a source without one goes); else they are the sizes to the
    power ``temperature``. ``total`` is the size of the mixture, that of the input if None.
    """
    sizes = docs.groupBy(source).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    sizes = written(sizes, "sizes")
    if weights is not None:
        table = docs.sparkSession.createDataFrame(list(weights.items()), "__name string, weight double")
        sizes = sizes.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("__name")), "left").drop("__name")
        sizes = sizes.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    all_size, all_weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    goal = float(total if total is not None else all_size or 0)
    share = F.col("weight") / F.lit(float(all_weight or 1.0) or 1.0)
    return sizes.select(source, "size", (share * F.lit(goal) / F.col("size")).alias("rate"))


def poisson_table(mean: Column) -> Column:
    """The distribution function at 0, 1, ... as an array, to where double precision ends."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None, seed: int = 1, source: str = "source", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The copies of the rows of ``docs``, all columns kept, with ``copy``, ``copies`` and ``shuffle_key``.

    Rows are dealt to partitions and sorted by ``shuffle_key``. A null source is a source
    of its own; null text counts as empty. Rows with equal ids (or null ones) draw the
    same count, but each is repeated. Very long texts are read whole, for their size only.
    An empty table gives no rows. Columns of ``docs`` that are named like the new ones are
    replaced; others keep their values, whatever they are called.
    """
    docs = docs.drop("copy", "copies", "shuffle_key")
    of, among, cdf = (free_name(docs, x) for x in ("__source", "__parts", "__cdf"))
    rates = source_rates(docs, weights, temperature, total, source)
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    rates = rates.filter("rate > 0").select(F.col(source).alias(of), parts.alias(among), poisson_table(F.col("rate") / parts).alias(cdf))
    rates = written(rates, "rates")
    if rates.count() <= broadcast_sources:
        rates = F.broadcast(rates)
    rows = docs.join(rates, F.col(source).eqNullSafe(F.col(of)))
    drawn = lambda j: let(uniform(F.lit(seed), F.lit("draw"), F.col("doc_id"), j), lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(among)), drawn), F.lit(0), lambda a, n: a + n)
    rows = rows.withColumn("copies", copies.cast("long")).filter("copies > 0").drop(of, among, cdf)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("shuffle_key", uniform(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("copy")))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def mixture_order(mixed: DataFrame, source: str = "source") -> DataFrame:
    """``(doc_id, source, copy, copies, position)``: each copy's place in the whole shuffle."""
    return indexed(mixed.select("doc_id", source, "copy", "copies", "shuffle_key"), ["shuffle_key", "doc_id", "copy"], "position").drop("shuffle_key")


def expected_standard_error(rate: float, rows: int) -> float:
    """Of the number of copies made of ``rows`` rows at ``rate``."""
    return math.sqrt(rate * rows)
