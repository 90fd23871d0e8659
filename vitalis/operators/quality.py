"""Data-quality rules (the entry screens' limits) and key checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims

# rule name -> predicate that must hold
PROFILE_RULES = {
    "age_14_90": F.col("age").between(14, 90),
    "height_120_230": F.col("height_cm").between(120, 230),
    "sex_known": F.col("sex").isin(*dims.SEXES),
    "activity_known": F.col("activity").isin(*[a for a, _ in dims.ACTIVITY]),
    "deficit_0_30": F.col("deficit_pct").between(0, 30),
    "protein_1.2_2.6": F.col("protein_g_per_kg").between(1.2, 2.6),
}
WEIGHT_RULES = {"kg_35_250": F.col("kg").between(35, 250)}
WORKOUT_RULES = {
    "sets_1_10": F.col("sets").between(1, 10),
    "reps_1_50": F.col("reps").between(1, 50),
    "kg_0_400": F.col("weight_kg").between(0, 400),
    "rpe_5_10": F.col("rpe").between(5, 10),
}
SUPPLEMENT_RULES = {"timing_known": F.col("timing").isin(*dims.TIMINGS)}
MEAL_RULES = {"meal_known": F.col("meal").isin(*dims.MEALS)}


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks (a NULL value breaks its rule), in
    rule order, comma-joined; empty string when clean."""
    arr = F.array(*[F.when(~F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in rules.items()])
    return F.array_join(F.filter(arr, lambda x: x.isNotNull()), ",")


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with a ``violations`` column)."""
    v = df.withColumn("violations", violations(rules))
    return v.where(F.col("violations") == "").drop("violations"), v.where(F.col("violations") != "")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
