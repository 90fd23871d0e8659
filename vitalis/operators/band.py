"""Band (wearable) data: readings -> daily metrics -> merged daily table ->
snapshot upsert -> readiness.

Shuffle plan. All kinds (sleep sessions, heart rate, steps, stress) become
long rows and one aggregation by (file, user, day, heart reading) computes every
metric: sums, counts, maxima and the histogram of a day's heart readings are partial
(map-side) aggregates, so a hot user, or a hot user-day, is combined before the
shuffle. The resting-HR percentile is found by rank in that histogram, exactly, from a
day's distinct values. The cross-file merge is one more group by (user, day), and
only when several files feed an import. Readiness partitions by user over the
*daily* table (at most one row per user-day), so its window state is bounded
by the length of a user's history, not by reading volume.

The per-kind functions (``sleep_daily`` ...) state each rule on its own and
give the same numbers as ``daily_metrics``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp01, exact_mean, exact_sum, finite_number, truthy
from ..functions.time import micros_between, offset_minutes, shift_minutes
from ..sources import dims
from . import blocks

DAILY_COLS = ["sleep_hours", "sleep_score", "resting_hr", "steps", "stress"]
MICROS_PER_HOUR = 3_600_000_000


def _keys(df: DataFrame, file_col: str | None):
    return (["file"] if file_col else []) + ["user_id", "day"]


def _with_file(df: DataFrame, file_col: str | None) -> DataFrame:
    return df.withColumnRenamed(file_col, "file") if file_col else df


def sleep_daily(sessions: DataFrame, file_col: str | None = None) -> DataFrame:
    """Sleep sessions (user_id, start_time, end_time, sleep_score,
    time_offset) -> (user_id, day, sleep_hours, sleep_score).

    The offset shifts both ends; hours = end - start; only 0 < h < 16 kept;
    the day is the local wake-up date. Hours are summed, the score averaged,
    per file and day.
    """
    df = _with_file(sessions, file_col)
    off = offset_minutes("time_offset") if "time_offset" in df.columns else F.lit(0)
    df = (df.withColumn("_off", off)
            .withColumn("_s", shift_minutes("start_time", "_off"))
            .withColumn("_e", shift_minutes("end_time", "_off"))
            .withColumn("_us", micros_between("_s", "_e"))
            .where((F.col("_us") > 0) & (F.col("_us") < 16 * MICROS_PER_HOUR))
            .withColumn("day", F.to_date("_e")))
    aggs = [(F.sum("_us") / MICROS_PER_HOUR).alias("sleep_hours")]
    if "sleep_score" in df.columns:
        aggs.append(exact_mean("sleep_score").alias("sleep_score"))
    return df.groupBy(*_keys(df, file_col)).agg(*aggs)


def resting_hr_daily(readings: DataFrame, file_col: str | None = None, min_readings: int = 6) -> DataFrame:
    """Heart-rate readings (user_id, ts, value) -> (user_id, day,
    resting_hr): 5th percentile (linear interpolation) of the day's readings
    strictly between 30 and 220, for days with at least ``min_readings``."""
    df = (_with_file(readings, file_col)
          .where((F.col("value") > 30) & (F.col("value") < 220))
          .withColumn("day", F.to_date("ts")))
    keys = _keys(df, file_col)
    counted = df.groupBy(*keys, "value").agg(F.count("value").alias("_c"))
    return (_ranked(counted, keys, "value", 0.05).groupBy(*keys)
              .agg(_at_rank("value", 0.05).alias("_p"), F.sum("_c").alias("_n"))
              .where(F.col("_n") >= min_readings)
              .select(*keys, F.bround("_p", 4).alias("resting_hr")))


def _ranked(counted: DataFrame, keys, value: str, p: float) -> DataFrame:
    """A histogram (keys, value, _c) with the readings up to each value (_upto) and
    the rank, from 0 and with a fraction, of the ``p`` quantile (_rank). The
    histogram is a partial aggregate: it combines before the shuffle, and what is
    ranked is a day's distinct values, not its readings."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (counted.withColumn("_upto", F.sum("_c").over(upto))
                   .withColumn("_rank", (F.sum("_c").over(w) - 1) * F.lit(p)))


def _at_rank(value: str, p: float) -> Column:
    """The quantile of a ranked histogram: the values on both sides of the rank,
    interpolated."""
    low = F.min(F.when(F.col("_upto") >= F.floor("_rank") + 1, F.col(value)))
    high = F.min(F.when(F.col("_upto") >= F.ceil("_rank") + 1, F.col(value)))
    rank = F.max("_rank")
    return F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)


def steps_daily(readings: DataFrame, file_col: str | None = None) -> DataFrame:
    """Step readings -> (user_id, day, steps): the day's maximum (step files
    hold running daily totals, so summing would double count)."""
    df = _with_file(readings, file_col).withColumn("day", F.to_date("ts"))
    return (df.groupBy(*_keys(df, file_col))
              .agg(F.bround(F.max(finite_number("value")), 0).try_cast("long").alias("steps")))


def stress_daily(readings: DataFrame, file_col: str | None = None) -> DataFrame:
    """Stress readings -> (user_id, day, stress): the day's mean; a day whose
    readings are all missing stays as a NULL row."""
    df = _with_file(readings, file_col).withColumn("day", F.to_date("ts"))
    return df.groupBy(*_keys(df, file_col)).agg(exact_mean("value").alias("stress"))


def merge_daily(*frames: DataFrame) -> DataFrame:
    """Outer column-union of per-file daily frames; when several files give
    the same metric for a day the maximum non-missing value wins."""
    parts = [f.drop("file") if "file" in f.columns else f for f in frames]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    for c in DAILY_COLS:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("double"))
    return (u.where(F.col("day").isNotNull())
             .groupBy("user_id", "day")
             .agg(*[F.max(c).alias(c) for c in DAILY_COLS]))


def sleep_rows(sessions: DataFrame, keys=("user_id",)) -> DataFrame:
    """Sleep sessions -> long rows (keys, day, kind='sleep', us, score):
    offset-shifted, 0 < hours < 16, day = local wake-up date."""
    off = offset_minutes("time_offset") if "time_offset" in sessions.columns else F.lit(0)
    score = F.col("sleep_score") if "sleep_score" in sessions.columns else F.lit(None).cast("double")
    df = (sessions.withColumn("_off", off)
                  .withColumn("_s", shift_minutes("start_time", "_off"))
                  .withColumn("_e", shift_minutes("end_time", "_off"))
                  .withColumn("_us", micros_between("_s", "_e")))
    return (df.where((F.col("_us") > 0) & (F.col("_us") < 16 * MICROS_PER_HOUR))
              .select(*keys, F.to_date("_e").alias("day"), F.lit("sleep").alias("kind"), F.col("_us").alias("us"),
                      score.cast("double").alias("score"), F.lit(None).cast("double").alias("value")))


def reading_rows(readings: DataFrame, keys=("user_id",)) -> DataFrame:
    """Readings (keys, ts, kind in heart/steps/stress, value) -> long rows."""
    return readings.select(*keys, F.to_date("ts").alias("day"), "kind", F.lit(None).cast("long").alias("us"),
                           F.lit(None).cast("double").alias("score"), F.col("value").cast("double").alias("value"))


def daily_metrics(rows: DataFrame, keys=("user_id",), min_readings: int = 6) -> DataFrame:
    """Long rows of every kind -> one row per (keys, day) with all five
    metrics: one partial aggregation for all kinds, then the ranks of a day's
    distinct heart readings.

    Same rules as the per-kind functions: sleep hours summed and score
    averaged; resting HR = 5th percentile of readings in (30, 220) on days
    with at least ``min_readings`` of them; steps = max; stress = mean. A day
    is kept when any kind contributes to it (a heart-only day needs enough
    readings).
    """
    k, v = F.col("kind"), F.col("value")
    hv = F.when((k == "heart") & (v > 30) & (v < 220), v)
    score, stress = F.when(k == "sleep", F.col("score")), F.when(k == "stress", v)
    # A row for each distinct heart reading of a day, one more for all the rest.
    part = (rows.where(F.col("day").isNotNull())
                .groupBy(*keys, "day", hv.alias("_hv"))
                .agg(F.count(hv).alias("_c"), F.sum(F.when(k == "sleep", F.col("us"))).alias("_us"),
                     exact_sum(score).alias("_ss"), F.count(score).alias("_cs"),
                     F.max(F.when(k == "steps", finite_number(v))).alias("_steps"),
                     exact_sum(stress).alias("_sr"), F.count(stress).alias("_cr"), F.count_if(k == "sleep").alias("_ns"),
                     F.count_if(k == "steps").alias("_nst"), F.count_if(k == "stress").alias("_nsr")))
    days = [*keys, "day"]
    mean = lambda s, n: F.when(F.sum(n) > 0, F.sum(s).cast("double") / F.sum(n))
    g = (_ranked(part, days, "_hv", 0.05).groupBy(*days)
         .agg((F.sum("_us") / MICROS_PER_HOUR).alias("sleep_hours"), mean("_ss", "_cs").alias("sleep_score"),
              _at_rank("_hv", 0.05).alias("_p"), F.sum("_c").alias("_nh"),
              F.bround(F.max("_steps"), 0).try_cast("long").alias("steps"), mean("_sr", "_cr").alias("stress"),
              *[F.sum(c).alias(c) for c in ("_ns", "_nst", "_nsr")]))
    keep = (F.col("_ns") > 0) | (F.col("_nh") >= min_readings) | (F.col("_nst") > 0) | (F.col("_nsr") > 0)
    return g.where(keep).select(
        *keys, "day", "sleep_hours", "sleep_score",
        F.when(F.col("_nh") >= min_readings, F.bround("_p", 4)).alias("resting_hr"), "steps", "stress")


METRIC_KIND = {"heart_rate": "heart", "steps": "steps", "stress": "stress"}


def band_daily_from_readings(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Long-format readings (metric in heart_rate/steps/stress) plus sleep
    sessions -> the daily table. Each metric has one source here, so the
    cross-file maximum is the identity and one aggregation does it all."""
    kind = F.col("metric")
    for m, kd in METRIC_KIND.items():
        kind = F.when(F.col("metric") == m, F.lit(kd)).otherwise(kind)
    r = readings.select("user_id", "ts", kind.alias("kind"), "value")
    return daily_metrics(sleep_rows(sessions).unionByName(reading_rows(r)))


def upsert_coalesce(old: DataFrame, new: DataFrame, key=("user_id", "day"), cols=DAILY_COLS) -> DataFrame:
    """New snapshot where each column is ``coalesce(new, old)``: an import
    never erases a value with a missing one. Idempotent."""
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = o.join(n, list(key), "full_outer")
    return j.select(*key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols])


def last_days(daily: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Rows with day >= as_of - days (no upper bound), in date order."""
    lo = F.date_sub(F.lit(as_of).cast("date"), days)
    return daily.where(F.col("day") >= lo)


def readiness(daily: DataFrame, baseline_days: int = 14, min_baseline: int = 3,
              block_days: int = blocks.BLOCK_DAYS) -> DataFrame:
    """Readiness per (user, day) of the daily table.

    Parts: sleep (weight 0.5) when sleep_hours is non-zero, mixing in the
    score when non-zero; resting HR (0.3) against the mean of the previous
    ``baseline_days`` days when at least ``min_baseline`` of them have one;
    stress (0.2) whenever present, 0 included. Score = round(100 * weighted
    mean of present parts); no part -> no row. The window runs over blocks of
    days, each with the last ``baseline_days`` before it.
    """
    w = blocks.days_back(["user_id"], "day", baseline_days, 1)
    d = (blocks.with_margin(daily, "day", baseline_days, block_days)
         .withColumn("_bn", F.count("resting_hr").over(w))
         .withColumn("_bs", F.sum(F.col("resting_hr").cast("decimal(18,4)")).over(w))
         .withColumn("_base", F.when(F.col("_bn") > 0, F.col("_bs").cast("double") / F.col("_bn"))))

    sh, ss, rhr, st = F.col("sleep_hours"), F.col("sleep_score"), F.col("resting_hr"), F.col("stress")
    s0 = clamp01(sh / 8)
    sleep_part = F.when(truthy(sh), F.when(truthy(ss), 0.5 * s0 + 0.5 * clamp01(ss / 100)).otherwise(s0))
    hr_ok = truthy(rhr) & (F.col("_bn") >= min_baseline)
    hr_part = F.when(hr_ok, clamp01(0.5 + (F.col("_base") - rhr) * 0.08))
    st_part = F.when(st.isNotNull(), clamp01(1 - st / 100))

    num = (F.lit(0.0) + F.coalesce(sleep_part * 0.5, F.lit(0.0))
           + F.coalesce(hr_part * 0.3, F.lit(0.0)) + F.coalesce(st_part * 0.2, F.lit(0.0)))
    den = (F.lit(0.0) + F.when(sleep_part.isNotNull(), 0.5).otherwise(0.0)
           + F.when(hr_part.isNotNull(), 0.3).otherwise(0.0) + F.when(st_part.isNotNull(), 0.2).otherwise(0.0))
    score = F.bround(100 * num / den, 0).cast("int")
    why = F.concat_ws(", ",
                      F.when(sleep_part.isNotNull(), F.format_string("slept %.1f h", F.bround(sh, 1))),
                      F.when(hr_part.isNotNull(), F.format_string(
                          "resting HR %d vs usual %d", F.bround(rhr, 0).cast("long"),
                          F.bround(F.col("_base"), 0).cast("long"))),
                      F.when(st_part.isNotNull(), F.format_string("stress %d", F.bround(st, 0).cast("long"))))
    out = (d.where((den > 0) & ~F.col("_margin"))
            .select("user_id", "day", score.alias("score"), why.alias("why")))
    call = (F.when(F.col("score") >= 75, dims.READY_PUSH)
             .when(F.col("score") >= 55, dims.READY_PLAN).otherwise(dims.READY_LIGHT))
    return out.select("user_id", "day", "score", call.alias("call"), "why")
