"""Body-weight operators: rolling mean, two-week trend, latest and as-of.

Windows run over blocks of days of a user (``operators.blocks``), so a history of
any length is spread over tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_mean
from . import blocks


def rolling_7d(weights: DataFrame, block_days: int = blocks.BLOCK_DAYS) -> DataFrame:
    """7-day time-based rolling mean (t-7d, t], emitted only for users with at
    least two weights."""
    w = blocks.days_back(["user_id"], "day", 6, 0)
    per_user = Window.partitionBy("user_id")
    # One row a block: whether the user has a second weight anywhere.
    counts = (weights.groupBy("user_id", blocks.block_of("day", block_days).alias("_block")).agg(F.count("*").alias("_n"))
              .withColumn("_n", F.sum("_n").over(per_user)).where(F.col("_n") >= 2).drop("_n"))
    placed = blocks.with_margin(weights.select("user_id", "day", "kg"), "day", 6, block_days)
    mean = placed.withColumn("avg_7d", F.sum(F.col("kg").cast("decimal(18,4)")).over(w).cast("double") / F.count("kg").over(w))
    same = F.col("m.user_id").eqNullSafe(F.col("c.user_id")) & F.col("m._block").eqNullSafe(F.col("c._block"))
    return (mean.where(~F.col("_margin")).alias("m").join(counts.alias("c"), same, "left_semi")
                .select("user_id", "day", "kg", "avg_7d"))


def trend(weights: DataFrame) -> DataFrame:
    """Per user: recent window (end-7d, end] and prior (end-14d, end-7d]
    around the user's last weight day; rate = difference of the means (kg per
    week), pct = 100 * rate / prior mean; fast_cut when pct < -1. Users
    lacking either window get no row."""
    end = weights.groupBy("user_id").agg(F.max("day").alias("_end"))
    j = weights.join(end, "user_id")
    age = F.datediff(F.col("_end"), F.col("day"))
    recent = F.when(age < 7, F.col("kg"))
    prior = F.when((age >= 7) & (age < 14), F.col("kg"))
    g = (j.groupBy("user_id", "_end")
          .agg(exact_mean(recent).alias("recent_mean"), exact_mean(prior).alias("prior_mean"))
          .where(F.col("recent_mean").isNotNull() & F.col("prior_mean").isNotNull()))
    rate = F.col("recent_mean") - F.col("prior_mean")
    return g.select(
        "user_id", F.col("_end").alias("end_day"), "recent_mean", "prior_mean",
        rate.alias("rate_kg_per_week"),
        (100 * rate / F.col("prior_mean")).alias("pct"),
        (100 * rate / F.col("prior_mean") < -1).alias("fast_cut"))


def latest(weights: DataFrame) -> DataFrame:
    """Last weight by date per user (weights are unique per user-day)."""
    return weights.groupBy("user_id").agg(F.max("day").alias("day"), F.max_by("kg", "day").alias("kg"))


def asof(weights: DataFrame, points: DataFrame, point_col: str = "point_day",
         block_days: int = blocks.BLOCK_DAYS) -> DataFrame:
    """For each (user_id, point_day) the latest weight with day <= point_day.

    A backward as-of join written as one window over the union of weights and
    query points, ordered by (day, kind) so a weight on the point day counts;
    the latest weight is carried forward, over blocks of days too. No range
    join, no pair explosion.
    """
    pts = points.select("user_id", F.col(point_col).alias("day")).distinct()
    u = (weights.select("user_id", "day", "kg", F.lit(0).alias("_kind"))
         .unionByName(pts.select("user_id", "day", F.lit(None).cast("double").alias("kg"), F.lit(1).alias("_kind"))))
    carried = blocks.carried_last(u, ["user_id"], ["day", "_kind"], "kg", "asof_kg", "day", block_days)
    return (carried.where(F.col("_kind") == 1)
                   .select("user_id", F.col("day").alias(point_col), "asof_kg"))
