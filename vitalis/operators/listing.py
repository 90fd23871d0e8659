"""Ordered listings with a global position, without a single-task window.

Rows are sorted over range partitions and written once with their partition and
place in it; the rows of each partition are counted, and a row's position is the
number of rows in the partitions before it plus its place. Only one count a
partition is ever in one place.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import fresh

_PLACE = (1 << 33) - 1  # monotonically_increasing_id: partition above, place below


def with_positions(rows: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """``rows`` with their position (from 0) in ``order``. Ties go by the other
    columns as text, so the listing is the same whatever partitions there are; rows
    equal in everything are interchangeable."""
    spark = rows.sparkSession
    rest = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))]
    keys = [F.col(o) if isinstance(o, str) else o for o in order] + rest
    path = fresh(spark, "listing")
    (rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id())
     .write.parquet(path))
    placed = spark.read.parquet(path)
    part = F.shiftright("__place", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = (placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return (placed.withColumn("__part", part).join(starts, "__part")
            .withColumn(name, (F.col("__start") + F.col("__place").bitwiseAND(F.lit(_PLACE))).cast("long"))
            .drop("__part", "__place", "__start"))


def numbered_within(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order`` within each ``group``: a row's global
    position less that of the group's first, so one huge group is spread over many
    tasks like any other rows."""
    placed = with_positions(rows, [*group, *order], "__position")
    first = placed.groupBy(*group).agg(F.min("__position").alias("__first"))
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return (placed.alias("p").join(first.alias("f"), on)
            .select(*[F.col(f"p.{c}") for c in rows.columns], (F.col("__position") - F.col("__first") + 1).alias(name)))
