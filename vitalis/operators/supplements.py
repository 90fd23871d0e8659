"""Supplement operators: log join, daily checklist, adherence.

Every user has a catalogue of their own; it is joined on user_id (and
supplement_id), and AQE picks the join by the measured sizes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label(name, dose, timing):
    """``name · dose · timing`` with separators and blanks stripped at both
    ends only (a missing middle dose leaves ``name ·  · timing``)."""
    s = F.concat(F.coalesce(name, F.lit("")), F.lit(" · "), F.coalesce(dose, F.lit("")), F.lit(" · "),
                 F.coalesce(timing, F.lit("")))
    return F.call_function("btrim", s, F.lit(" ·"))


def active(supplements: DataFrame) -> DataFrame:
    return supplements.where(F.col("active") == 1)


def stack_text(supplements: DataFrame) -> DataFrame:
    """Per user, the active supplements as one text: ``name, dose, timing`` lines
    in catalogue order (missing values print as None)."""
    line = F.concat_ws(", ", *[F.coalesce(F.col(c), F.lit("None")) for c in ("name", "dose", "timing")])
    return (active(supplements).withColumn("_line", line).groupBy("user_id")
            .agg(F.expr("listagg(_line, '\\n') within group (order by supplement_id, _line)").alias("stack")))


def log_join(log: DataFrame, supplements: DataFrame) -> DataFrame:
    """Log rows with their supplement; rows of unknown ids vanish. The join
    strategy is left to AQE (it broadcasts the catalogue only after measuring
    it below the threshold)."""
    s = supplements.select("user_id", "supplement_id", "name")
    return log.join(s, ["user_id", "supplement_id"]).select("user_id", "day", "supplement_id", "name", "taken")


def checklist(spine: DataFrame, log: DataFrame, supplements: DataFrame) -> DataFrame:
    """For each (user_id, day) of ``spine``, every active supplement of the
    user's catalogue with its label and ``taken`` (0 when not logged)."""
    act = active(supplements).select("user_id", "supplement_id", "name", "dose", "timing")
    rows = spine.join(act, "user_id")
    j = rows.join(log.select("user_id", "day", "supplement_id", "taken"), ["user_id", "day", "supplement_id"], "left")
    return j.select("user_id", "day", "supplement_id", "timing", "name",
                    label(F.col("name"), F.col("dose"), F.col("timing")).alias("label"),
                    F.coalesce("taken", F.lit(0)).alias("taken"))


def active_counts(supplements: DataFrame) -> DataFrame:
    """Active supplements per user."""
    return supplements.groupBy("user_id").agg(F.count_if(F.col("active") == 1).alias("n_active"))


def adherence_recent(log: DataFrame, supplements: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Sum of ``taken`` per (user, supplement name) over day >= as_of - days
    (inclusive, no upper bound) for supplements in the catalogue."""
    lo = F.date_sub(F.lit(as_of).cast("date"), days)
    return (log_join(log.where(F.col("day") >= lo), supplements)
            .groupBy("user_id", "name").agg(F.sum("taken").cast("long").alias("taken")))


def week_adherence(log: DataFrame, supplements: DataFrame) -> DataFrame:
    """Per (user, week): round(100 * taken / (7 * active count)); every log
    row counts (inactive and unknown ids too), so it can exceed 100; NULL
    when nothing is active."""
    from ..functions.time import week_start
    n = F.col("n_active")
    w = log.withColumn("week_start", week_start("day")).groupBy("user_id", "week_start").agg(
        F.sum("taken").cast("long").alias("taken"))
    w = w.join(active_counts(supplements), "user_id", "left")
    return w.select("user_id", "week_start", "taken",
                    F.when(n > 0, F.bround(100 * F.col("taken") / (7 * n), 0).cast("long"))
                     .alias("supplement_adherence_pct"))
