"""Constant dimensions.

Everything between the FIXED VALUES markers must equal the values of the
original application for results to agree: per-100 g nutrition, household
unit grams and aliases of the 61 built-in foods, the 48-exercise library, the
equipment profiles, activity multipliers and unit tables. They are kept in
their natural (source) order because that order decides fuzzy-match ties and
the ``food_id`` / ``exercise_id`` numbering of the derived input tables.

The dimensions become small DataFrames (``createDataFrame``); their size is
fixed by this file, so broadcasting them is always safe.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ----------------------------- FIXED VALUES -----------------------------
# Built-in foods: name, kcal, protein, carbs, fat (per 100 g or 100 ml),
# household units {unit: grams}, aliases.
FOODS = [
    ("egg", 155, 13, 1.1, 11, {"piece": 50}, ["eggs", "boiled egg", "whole egg", "omelette", "omelet"]),
    ("egg white", 52, 11, 0.7, 0.2, {"piece": 33}, ["egg whites"]),
    ("chicken breast", 165, 31, 0, 3.6, {"piece": 150, "serving": 150}, ["grilled chicken", "chicken"]),
    ("chicken curry", 150, 14, 4, 9, {"bowl": 200, "serving": 200}, []),
    ("mutton curry", 200, 16, 3, 14, {"bowl": 200, "serving": 200}, []),
    ("fish", 128, 22, 0, 4, {"piece": 120, "serving": 150}, ["fish fillet", "rohu"]),
    ("salmon", 206, 22, 0, 12, {"piece": 150}, []),
    ("tuna", 116, 26, 0, 1, {"can": 120}, ["canned tuna"]),
    ("paneer", 265, 18, 1.2, 21, {"serving": 100, "piece": 25}, ["cottage cheese"]),
    ("tofu", 76, 8, 1.9, 4.8, {"serving": 100}, []),
    ("soya chunks", 345, 52, 33, 0.5, {"cup": 50, "serving": 50}, ["soy chunks", "nutrela"]),
    ("whey protein", 400, 80, 8, 6, {"scoop": 30}, ["whey", "protein shake", "protein powder"]),
    ("protein bar", 360, 30, 40, 10, {"piece": 60}, []),
    ("milk", 60, 3.2, 4.8, 3.0, {"glass": 250, "cup": 240}, ["toned milk"]),
    ("curd", 61, 3.5, 4.7, 3.3, {"bowl": 150, "cup": 245}, ["dahi", "yogurt", "yoghurt"]),
    ("greek yogurt", 59, 10, 3.6, 0.4, {"cup": 170, "bowl": 170}, []),
    ("buttermilk", 25, 1.5, 2.5, 1, {"glass": 250}, ["chaas"]),
    ("cheese slice", 300, 18, 6, 23, {"slice": 20, "piece": 20}, ["cheese"]),
    ("butter", 717, 0.9, 0.1, 81, {"tbsp": 14, "tsp": 5}, []),
    ("ghee", 900, 0, 0, 100, {"tbsp": 13, "tsp": 5}, []),
    ("white rice", 130, 2.7, 28, 0.3, {"cup": 160, "bowl": 200, "plate": 250}, ["rice", "cooked rice", "chawal"]),
    ("brown rice", 112, 2.3, 24, 0.8, {"cup": 160, "bowl": 200}, []),
    ("roti", 297, 9.6, 46, 7.4, {"piece": 40}, ["chapati", "phulka", "chapatti"]),
    ("paratha", 326, 6.4, 45, 13, {"piece": 80}, ["aloo paratha"]),
    ("oats", 389, 16.9, 66, 6.9, {"cup": 80, "tbsp": 10, "bowl": 50}, ["oatmeal", "rolled oats"]),
    ("white bread", 265, 9, 49, 3.2, {"slice": 25}, ["bread"]),
    ("brown bread", 247, 13, 41, 3.4, {"slice": 28}, ["whole wheat bread", "multigrain bread"]),
    ("pasta", 158, 5.8, 31, 0.9, {"cup": 140, "bowl": 200, "plate": 250}, []),
    ("potato", 87, 1.9, 20, 0.1, {"piece": 150}, ["boiled potato", "aloo"]),
    ("sweet potato", 76, 1.4, 17.7, 0.1, {"piece": 150}, []),
    ("poha", 180, 3.5, 30, 5, {"plate": 200, "bowl": 150}, []),
    ("upma", 150, 3.5, 22, 5, {"plate": 200, "bowl": 150}, []),
    ("idli", 146, 4.5, 30, 0.4, {"piece": 40}, []),
    ("dosa", 168, 3.9, 29, 3.7, {"piece": 75}, []),
    ("khichdi", 120, 4.5, 20, 2.5, {"bowl": 250, "plate": 300}, []),
    ("instant noodles", 440, 9, 62, 17, {"pack": 70}, ["maggi"]),
    ("dal", 105, 6.5, 15, 2.5, {"bowl": 200, "cup": 200}, ["dal tadka", "lentils", "dal fry"]),
    ("rajma", 127, 8.7, 22.8, 0.5, {"bowl": 200}, ["kidney beans"]),
    ("chole", 164, 8.9, 27.4, 2.6, {"bowl": 200}, ["chickpeas", "chana"]),
    ("sambar", 60, 3, 9, 1.5, {"bowl": 200}, []),
    ("mixed veg sabzi", 90, 2.5, 9, 5, {"bowl": 150}, ["sabzi", "vegetable curry", "veg curry"]),
    ("broccoli", 34, 2.8, 7, 0.4, {"cup": 90}, []),
    ("spinach", 23, 2.9, 3.6, 0.4, {"cup": 30}, ["palak"]),
    ("salad", 20, 1, 4, 0.2, {"bowl": 150, "plate": 150}, ["green salad", "mixed salad"]),
    ("banana", 89, 1.1, 22.8, 0.3, {"piece": 118}, []),
    ("apple", 52, 0.3, 14, 0.2, {"piece": 180}, []),
    ("orange", 47, 0.9, 12, 0.1, {"piece": 130}, []),
    ("mango", 60, 0.8, 15, 0.4, {"piece": 200}, []),
    ("watermelon", 30, 0.6, 7.6, 0.2, {"cup": 150, "bowl": 250}, []),
    ("peanut butter", 588, 25, 20, 50, {"tbsp": 16, "tsp": 5}, []),
    ("peanuts", 567, 25.8, 16, 49, {"handful": 30}, []),
    ("almonds", 579, 21, 22, 50, {"piece": 1.2, "handful": 28}, ["badam"]),
    ("olive oil", 884, 0, 0, 100, {"tbsp": 13.5, "tsp": 4.5}, ["oil", "cooking oil"]),
    ("honey", 304, 0.3, 82, 0, {"tbsp": 21, "tsp": 7}, []),
    ("sugar", 387, 0, 100, 0, {"tsp": 4, "tbsp": 12.5}, []),
    ("tea with milk", 40, 1, 6.5, 1, {"cup": 150}, ["chai", "tea"]),
    ("black coffee", 2, 0.3, 0, 0, {"cup": 240}, ["coffee", "americano"]),
    ("cola", 42, 0, 10.6, 0, {"can": 330, "glass": 250}, ["coke", "pepsi", "soft drink"]),
    ("pizza", 266, 11, 33, 10, {"slice": 107}, []),
    ("burger", 250, 13, 28, 10, {"piece": 220}, []),
    ("samosa", 308, 5, 32, 18, {"piece": 60}, []),
]

# Exercise library: name, muscle group, equipment kind.
LIBRARY = [
    ("Barbell Back Squat", "Legs", "gym"), ("Leg Press", "Legs", "gym"),
    ("Romanian Deadlift", "Hamstrings", "gym"), ("Conventional Deadlift", "Back", "gym"),
    ("Leg Extension", "Quads", "gym"), ("Lying Leg Curl", "Hamstrings", "gym"),
    ("Hip Thrust", "Glutes", "gym"), ("Seated Calf Raise", "Calves", "gym"),
    ("Barbell Bench Press", "Chest", "gym"), ("Machine Chest Press", "Chest", "gym"),
    ("Cable Fly", "Chest", "gym"), ("Overhead Press", "Shoulders", "gym"),
    ("Cable Lateral Raise", "Shoulders", "gym"), ("Face Pull", "Rear delts", "gym"),
    ("Lat Pulldown", "Back", "gym"), ("Seated Cable Row", "Back", "gym"),
    ("Barbell Row", "Back", "gym"), ("Pull-up", "Back", "gym"), ("Dips", "Chest", "gym"),
    ("Triceps Pushdown", "Triceps", "gym"), ("EZ-Bar Curl", "Biceps", "gym"),
    ("Hanging Leg Raise", "Core", "gym"), ("Incline Treadmill Walk", "Cardio", "gym"),
    ("Stationary Bike", "Cardio", "gym"),
    ("Dumbbell Bench Press", "Chest", "dumbbell"), ("Incline Dumbbell Press", "Chest", "dumbbell"),
    ("Dumbbell Fly", "Chest", "dumbbell"), ("Dumbbell Shoulder Press", "Shoulders", "dumbbell"),
    ("Dumbbell Lateral Raise", "Shoulders", "dumbbell"), ("One-Arm Dumbbell Row", "Back", "dumbbell"),
    ("Goblet Squat", "Legs", "dumbbell"), ("Dumbbell Romanian Deadlift", "Hamstrings", "dumbbell"),
    ("Bulgarian Split Squat", "Legs", "dumbbell"), ("Dumbbell Lunge", "Legs", "dumbbell"),
    ("Dumbbell Curl", "Biceps", "dumbbell"), ("Hammer Curl", "Biceps", "dumbbell"),
    ("Overhead Dumbbell Triceps Extension", "Triceps", "dumbbell"), ("Dumbbell Shrug", "Traps", "dumbbell"),
    ("Push-up", "Chest", "bodyweight"), ("Pike Push-up", "Shoulders", "bodyweight"),
    ("Bodyweight Squat", "Legs", "bodyweight"), ("Walking Lunge", "Legs", "bodyweight"),
    ("Glute Bridge", "Glutes", "bodyweight"), ("Standing Calf Raise", "Calves", "bodyweight"),
    ("Plank", "Core", "bodyweight"), ("Side Plank", "Core", "bodyweight"),
    ("Dead Bug", "Core", "bodyweight"), ("Brisk Walk", "Cardio", "bodyweight"),
]

# Equipment profile -> allowed equipment kinds.
EQUIPMENT = [
    ("Full gym", ["gym", "dumbbell", "bodyweight"]),
    ("Dumbbells at home", ["dumbbell", "bodyweight"]),
    ("Bodyweight only", ["bodyweight"]),
]

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Activity level -> TDEE multiplier; anything else uses DEFAULT_ACTIVITY.
ACTIVITY = [
    ("Sedentary", 1.2),
    ("Light (1-3 workouts/week)", 1.375),
    ("Moderate (3-5 workouts/week)", 1.55),
    ("Very active (6-7 workouts/week)", 1.725),
    ("Athlete (2x/day or physical job)", 1.9),
]
DEFAULT_ACTIVITY = 1.55

# Legal units told to the meal parser.
UNITS = ["g", "ml", "piece", "slice", "cup", "bowl", "plate", "scoop", "tbsp",
         "tsp", "glass", "handful", "can", "pack", "serving"]

# Unit synonym -> canonical unit.
UNIT_SYNONYMS = [
    ("gm", "g"), ("gms", "g"), ("gram", "g"), ("grams", "g"), ("kg", "kg"), ("l", "l"),
    ("litre", "l"), ("liter", "l"), ("pc", "piece"), ("pcs", "piece"), ("pieces", "piece"),
    ("whole", "piece"), ("slices", "slice"), ("cups", "cup"), ("bowls", "bowl"),
    ("katori", "bowl"), ("plates", "plate"), ("scoops", "scoop"),
    ("tablespoon", "tbsp"), ("teaspoon", "tsp"), ("glasses", "glass"),
]

# Grams for a unit the food itself does not define; anything else uses
# DEFAULT_FALLBACK_GRAMS.
FALLBACK_GRAMS = [
    ("glass", 250), ("cup", 240), ("bowl", 200), ("plate", 250),
    ("tbsp", 15), ("tsp", 5), ("handful", 30), ("scoop", 30),
    ("serving", 100), ("piece", 100), ("slice", 30), ("can", 330), ("pack", 70),
]
DEFAULT_FALLBACK_GRAMS = 100

# Form limits of the entry screens, used as data-quality rules.
MEALS = ["Breakfast", "Lunch", "Dinner", "Snack", "Pre-workout", "Post-workout"]
TIMINGS = ["Morning", "Pre-workout", "Post-workout", "With lunch", "With dinner", "Before bed"]
SEXES = ["Male", "Female"]

# Fuzzy-match cutoffs: food names (lower-cased input), plan exercises and lab
# markers (case kept).
FOOD_MATCH_CUTOFF = 85
EXERCISE_MATCH_CUTOFF = 90
MARKER_MATCH_CUTOFF = 90

# Band-file routing on the lower-cased base name.
SLEEP_EXCLUDE = ["stage", "combined", "snor", "goal", "raw"]

# Readiness weights and calls.
READY_PUSH = "Ready to push. Go for top sets today."
READY_PLAN = "Train as planned."
READY_LIGHT = "Go lighter: drop a set per exercise and keep effort around RPE 7."
# --------------------------- END FIXED VALUES ---------------------------


def food_choices() -> list[tuple[int, str, int]]:
    """(ord, choice string, food_id): each food key followed by its aliases,
    in source order. ``ord`` decides ties (lowest wins)."""
    out = []
    for fid, (name, *_rest, aliases) in enumerate(FOODS):
        out.append((len(out), name, fid))
        for a in aliases:
            out.append((len(out), a, fid))
    return out


FOOD_SCHEMA = T.StructType([
    T.StructField("food_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("kcal", T.DoubleType(), False),
    T.StructField("protein", T.DoubleType(), False),
    T.StructField("carbs", T.DoubleType(), False),
    T.StructField("fat", T.DoubleType(), False),
    T.StructField("units", T.MapType(T.StringType(), T.DoubleType()), False),
])


def food_df(spark: SparkSession) -> DataFrame:
    rows = [(i, n, float(k), float(p), float(c), float(f), {u: float(g) for u, g in units.items()})
            for i, (n, k, p, c, f, units, _a) in enumerate(FOODS)]
    return spark.createDataFrame(rows, FOOD_SCHEMA)


def food_choice_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(food_choices(), "ord long, choice string, food_id long")


def exercise_df(spark: SparkSession) -> DataFrame:
    rows = [(i, n, m, e) for i, (n, m, e) in enumerate(LIBRARY)]
    return spark.createDataFrame(rows, "exercise_id long, name string, muscle string, equipment string")


def equipment_kind_df(spark: SparkSession) -> DataFrame:
    rows = [(p, k) for p, kinds in EQUIPMENT for k in kinds]
    return spark.createDataFrame(rows, "profile string, kind string")


# --- SQL text of the same dimensions (for the DuckDB oracle) ---

def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def values_sql(rows, cols, types) -> str:
    """``(SELECT CAST(c1 AS t1) AS c1, ... FROM (VALUES ...) v(c1, ...))``."""
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    sel = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(cols, types))
    return f"(SELECT {sel} FROM (VALUES {body}) v({', '.join(cols)}))"


def food_sql() -> str:
    rows = [(i, n, float(k), float(p), float(c), float(f)) for i, (n, k, p, c, f, _u, _a) in enumerate(FOODS)]
    return values_sql(rows, ["food_id", "name", "kcal", "protein", "carbs", "fat"],
                      ["BIGINT", "VARCHAR", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE"])


def food_unit_sql() -> str:
    rows = [(i, u, float(g)) for i, (_n, _k, _p, _c, _f, units, _a) in enumerate(FOODS) for u, g in units.items()]
    return values_sql(rows, ["food_id", "unit", "grams"], ["BIGINT", "VARCHAR", "DOUBLE"])


def food_choice_sql() -> str:
    return values_sql(food_choices(), ["ord", "choice", "food_id"], ["BIGINT", "VARCHAR", "BIGINT"])


def exercise_sql() -> str:
    rows = [(i, n, m, e) for i, (n, m, e) in enumerate(LIBRARY)]
    return values_sql(rows, ["exercise_id", "name", "muscle", "equipment"],
                      ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR"])


def activity_sql() -> str:
    return values_sql(ACTIVITY, ["activity", "multiplier"], ["VARCHAR", "DOUBLE"])


def unit_synonym_sql() -> str:
    return values_sql(UNIT_SYNONYMS, ["alias", "unit"], ["VARCHAR", "VARCHAR"])


def fallback_grams_sql() -> str:
    return values_sql([(u, float(g)) for u, g in FALLBACK_GRAMS], ["unit", "grams"], ["VARCHAR", "DOUBLE"])


def equipment_kind_sql() -> str:
    rows = [(p, k) for p, kinds in EQUIPMENT for k in kinds]
    return values_sql(rows, ["profile", "kind"], ["VARCHAR", "VARCHAR"])
