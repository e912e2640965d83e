"""Column expressions and distributed numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.session import written

#: The bits that ``monotonically_increasing_id`` leaves to the row within a partition.
ROW_BITS = 33


def rules_worth_inlining(length: Column, freq: Column, threshold: int = 16) -> Column:
    """True where a rule saves too little: (freq - 1) * (length - 1) - 1 <= threshold."""
    return (freq - 1) * (length - 1) - 1 <= F.lit(threshold)


def rules_worth_inlining_decomposed(length: Column, freq: Column, min_freq: int = 4, min_length: int = 4, mode: str = "and") -> Column:
    """True where a rule is short and rare (``and``), or short or rare (``or``)."""
    short, rare = length < F.lit(min_length), freq < F.lit(min_freq)
    if mode not in ("and", "or"):
        raise ValueError(f"mode is 'and' or 'or', not {mode!r}")
    return short & rare if mode == "and" else short | rare


def _placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, str, str]:
    """``df`` range-partitioned and sorted by ``order``, with its partition and place."""
    part, place = "__part", "__place"
    df = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    df = written(df.withColumn(place, F.monotonically_increasing_id()), "placed")
    return df.withColumn(part, F.shiftright(F.col(place), ROW_BITS)), part, place


def _offsets(df: DataFrame, part: str, total: Column) -> DataFrame:
    """What the partitions before each one hold; a row per partition, so one small window."""
    sums = df.groupBy(part).agg(total.alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def indexed(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Gapless numbers from 0 in ``order``, without a window over all rows.

    Rows are range-partitioned; only the row count of each partition is summed globally.
    """
    df, part, place = _placed(df, order)
    offsets = F.broadcast(_offsets(df, part, F.count(F.lit(1))))
    row = F.col(place).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return df.join(offsets, part).withColumn(name, row + F.col("__before")).drop(part, place, "__before")


def running_total(df: DataFrame, order: list[str], value: str, name: str = "offset") -> DataFrame:
    """The sum of ``value`` over the rows before each one in ``order`` (exclusive)."""
    df, part, place = _placed(df, order)
    offsets = F.broadcast(_offsets(df, part, F.sum(value)))
    before = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(before), F.lit(0))
    return df.withColumn("__own", own).join(offsets, part).withColumn(name, F.col("__own") + F.col("__before")).drop(part, place, "__own", "__before")


def placed_in_group(df: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """Gapless numbers from 0 within each ``group`` in ``order``; no task holds a whole group.

    Rows are range-partitioned, so only the first group of a partition can have begun
    before it. What it has there is a row per partition and such group, and is broadcast.
    """
    df, part, place = _placed(df, [group, *order])
    first = F.broadcast(df.groupBy(part).agg(F.min(group).alias(group)).select(group).distinct())
    counts = df.join(first, group, "left_semi").groupBy(part, group).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(counts.select(part, group, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    own = F.row_number().over(Window.partitionBy(part, group).orderBy(place)) - 1
    out = df.withColumn("__own", own).join(before, [part, group], "left")
    return out.withColumn(name, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long")).drop(part, place, "__own", "__before")
