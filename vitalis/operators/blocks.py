"""Windows over long histories, cut into blocks of days.

A window by user holds the whole history of a user in one task. Here a history is
cut into blocks of ``BLOCK_DAYS`` days and windows run by (user, block). What a block
needs of the ones before it comes as copies of the last days of its predecessor
(ranges of days) or as one carried value a block (running values): windows over
blocks hold one row for each of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.time import epoch_day

BLOCK_DAYS = 1024


def block_of(day, days: int = BLOCK_DAYS) -> Column:
    return F.floor(epoch_day(day) / F.lit(days)).cast("long")


def with_margin(rows: DataFrame, day: str, before: int, days: int = BLOCK_DAYS) -> DataFrame:
    """``rows`` with ``_block`` and ``_margin``: every row in its block, and rows of the
    last ``before`` days of a block once more, as margin, in each later block that
    reaches back to them. Rows without a day are in no block and keep to themselves."""
    n = epoch_day(day)
    last = F.floor((n + before) / F.lit(days)).cast("long")
    blocks = F.when(n.isNotNull(), F.sequence(block_of(day, days), last)).otherwise(F.array(F.lit(None).cast("long")))
    placed = rows.select("*", F.posexplode(blocks).alias("_at", "_block"))
    return placed.withColumn("_margin", F.col("_at") > 0).drop("_at")


def days_back(by: list[str], day: str, first: int, last: int) -> WindowSpec:
    """Window over the days ``first`` to ``last`` before each row of ``with_margin``."""
    return Window.partitionBy(*by, "_block").orderBy(epoch_day(day)).rangeBetween(-first, -last)


def carried_last(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, day: str,
                 days: int = BLOCK_DAYS) -> DataFrame:
    """``rows`` with ``out``: the last ``value`` that is not null at or before each row, in
    the order ``order`` (which begins with ``day``) within ``by``. The last value of each
    block is found by a partial aggregate and carried over the blocks behind it."""
    placed = rows.withColumn("_block", block_of(day, days))
    held = F.when(F.col(value).isNotNull(), F.struct(*order, value))
    ends = placed.groupBy(*by, "_block").agg(F.max(held)[value].alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    # The carry row of a block comes before its rows; rows and carries meet in one
    # window, so a block is shuffled once and nothing is joined.
    lead = carry.where(F.col("_carry").isNotNull()).select(*by, "_block", F.col("_carry").alias(value), F.lit(0).alias("_lead"))
    both = placed.withColumn("_lead", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    upto = Window.partitionBy(*by, "_block").orderBy("_lead", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (both.withColumn(out, F.last(value, ignorenulls=True).over(upto))
                .where(F.col("_lead") == 1).drop("_block", "_lead"))
