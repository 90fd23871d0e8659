"""Weekly check-in: one 15-field row per (user, week).

Plan shape. Every fact table is reduced to (user, day) rows with partial
aggregates, so a user holding a third of all rows is spread across its days;
one union and one group by (user, week) then produce all weekly numbers; a
window over that weekly table (bounded: one row per user-week) carries the
latest weight forward for the target; the profile join is on user_id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_mean
from ..functions.nutrition import targets
from ..functions.time import week_start
from ..operators.supplements import active_counts

KEY = ["user_id", "week_start"]

WEEK_STATS_COLUMNS = [
    "user_id", "week_start", "week", "days_food_logged", "avg_calories", "calorie_target", "avg_protein_g",
    "protein_target_g", "days_protein_target_hit", "training_days", "total_working_sets",
    "weight_start_kg", "weight_end_kg", "avg_sleep_hours", "avg_resting_hr", "avg_steps",
    "supplement_adherence_pct",
]


def _wk(df: DataFrame) -> DataFrame:
    return df.withColumn("week_start", week_start("day"))


def week_stats(profile: DataFrame, weights: DataFrame, food: DataFrame, workouts: DataFrame,
               band_daily: DataFrame, supplement_log: DataFrame, supplements: DataFrame) -> DataFrame:
    """``food`` is the enriched food log (kcal, protein per row).

    Plan: the five sources become (user, day) rows of one wide union (food
    and workouts pre-aggregated per day, map-side), then a single group by
    (user, week) computes every weekly number. The as-of weight at each
    week's end is the last non-null weekly closing weight carried forward by a
    window over the weekly table (one row per user-week). Days at the protein
    target are counted from the week's daily protein list, at most 7 values.
    """
    dec1 = "decimal(18,1)"
    food_day = (food.groupBy("user_id", "day")
                    .agg(F.sum(F.col("kcal").cast(dec1)).alias("kcal"), F.sum(F.col("protein").cast(dec1)).alias("protein"))
                    .withColumn("_food", F.lit(1)))
    lift_day = (workouts.groupBy("user_id", "day").agg(F.sum("sets").cast("long").alias("sets"))
                        .withColumn("_train", F.lit(1)))
    rows = (food_day
            .unionByName(weights.select("user_id", "day", "kg"), allowMissingColumns=True)
            .unionByName(band_daily.select("user_id", "day", "sleep_hours", "resting_hr", "steps"),
                         allowMissingColumns=True)
            .unionByName(lift_day, allowMissingColumns=True)
            .unionByName(supplement_log.select("user_id", "day", "taken"), allowMissingColumns=True))
    wk = _wk(rows).groupBy(*KEY).agg(
        F.count("_food").alias("days_food_logged"),
        F.sum("kcal").alias("_kcal_sum"), F.sum("protein").alias("_protein_sum"),
        F.collect_list("protein").alias("_proteins"),
        F.min_by("kg", F.when(F.col("kg").isNotNull(), F.col("day"))).alias("_w0"),
        F.max_by("kg", F.when(F.col("kg").isNotNull(), F.col("day"))).alias("_w1"),
        exact_mean("sleep_hours", 6).alias("_sleep"),
        exact_mean("resting_hr", 4).alias("_rhr"),
        exact_mean("steps", 0).alias("_steps"),
        F.count("_train").alias("training_days"),
        F.sum("sets").alias("total_working_sets"),
        F.sum("taken").alias("_taken"))
    carry = (Window.partitionBy("user_id").orderBy("week_start")
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wk = wk.withColumn("_asof_kg", F.last("_w1", ignorenulls=True).over(carry))
    j = wk.join(profile, "user_id", "left")
    t = targets("_asof_kg", "height_cm", "age", "sex", "activity", "deficit_pct", "protein_g_per_kg")
    j = j.withColumn("_t", t)
    n_food = F.col("days_food_logged")
    j = j.join(active_counts(supplements), "user_id", "left")
    n_active = F.col("n_active")
    adherence = F.when(n_active > 0, F.bround(100 * F.coalesce(F.col("_taken"), F.lit(0)) / (7 * n_active), 0)
                       .cast("long"))
    hit = F.when(F.col("_t.protein").isNotNull(),
                 F.size(F.filter("_proteins", lambda p: p >= 0.9 * F.col("_t.protein")))).otherwise(F.lit(0))
    end = F.date_add("week_start", 6)
    return j.select(
        "user_id", "week_start",
        F.concat(F.col("week_start").cast("string"), F.lit(" to "), end.cast("string")).alias("week"),
        n_food.cast("long").alias("days_food_logged"),
        F.bround(F.when(n_food > 0, F.col("_kcal_sum").cast("double") / n_food), 0).alias("avg_calories"),
        F.bround("_t.kcal", 0).alias("calorie_target"),
        F.bround(F.when(n_food > 0, F.col("_protein_sum").cast("double") / n_food), 0).alias("avg_protein_g"),
        F.bround("_t.protein", 0).alias("protein_target_g"),
        hit.cast("long").alias("days_protein_target_hit"),
        F.col("training_days").cast("long").alias("training_days"),
        F.coalesce("total_working_sets", F.lit(0)).cast("long").alias("total_working_sets"),
        F.bround("_w0", 1).alias("weight_start_kg"),
        F.bround("_w1", 1).alias("weight_end_kg"),
        F.bround("_sleep", 1).alias("avg_sleep_hours"),
        F.bround("_rhr", 0).alias("avg_resting_hr"),
        F.bround("_steps", 0).alias("avg_steps"),
        adherence.alias("supplement_adherence_pct"),
    )


def stats_payload(stats: DataFrame) -> DataFrame:
    """Week stats as one JSON object per row (nulls kept), the input of the
    weekly note."""
    fields = [c for c in WEEK_STATS_COLUMNS if c not in ("user_id", "week_start")]
    return stats.select("user_id", "week_start",
                        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
