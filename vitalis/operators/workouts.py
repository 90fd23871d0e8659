"""Training operators: allowed library, estimated 1RM trends, plan views.

The exercise library and equipment profiles are fixed-size dimensions
(48 and 6 rows), broadcast explicitly.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.training import e1rm


def allowed_exercises(library: DataFrame, equipment_kind: DataFrame) -> DataFrame:
    """(equipment profile, name, exercise_id) for every library exercise the
    profile's equipment allows."""
    return (library.join(F.broadcast(equipment_kind), library["equipment"] == equipment_kind["kind"])
                   .select(F.col("profile").alias("equipment"), "name", "exercise_id"))


def e1rm_trend(workouts: DataFrame, library: DataFrame) -> DataFrame:
    """Per (user, exercise, day) the best estimated one-rep max (Epley)."""
    w = workouts.join(F.broadcast(library.select("exercise_id", F.col("name").alias("exercise"))), "exercise_id")
    return (w.groupBy("user_id", "exercise", "day")
             .agg(F.max(e1rm("weight_kg", "reps")).alias("e1rm")))


def known_exercises(workouts: DataFrame, library: DataFrame) -> DataFrame:
    w = workouts.join(F.broadcast(library.select("exercise_id", F.col("name").alias("exercise"))), "exercise_id")
    return w.select("user_id", "exercise").distinct()


def normalise_plan(raw: DataFrame, allowed: DataFrame, id_cols: list[str], cutoff: float = 90) -> DataFrame:
    """Raw plan rows (``model_json.plan_days`` + an ``equipment`` column) ->
    library-checked plan rows: each exercise name replaced by its library
    match for the equipment profile (cutoff 90, case kept), unmatched
    exercises dropped, days left without exercises dropped (an inner join
    does both). ``weekday_idx`` gives the Mon..Sun order.

    The rows are dealt by document once, behind a generator that keeps every column:
    their names and they themselves come from that one shuffle, so that the model's
    texts are read once and not again for the names."""
    from ..sources import dims
    from . import fuzzy
    doc = ["_doc"] if "_doc" in raw.columns else list(id_cols)
    raw = raw.repartition(*doc).select(F.inline(F.array(F.struct(*raw.columns))))
    m = fuzzy.match_exercise(raw.select("equipment", F.col("raw_name").alias("mention")), allowed, cutoff)
    m = m.where(F.col("matched").isNotNull()).select("equipment", F.col("mention").alias("raw_name"), "matched")
    j = raw.join(m, ["equipment", "raw_name"])
    idx = F.array_position(F.array(*[F.lit(d) for d in dims.WEEKDAYS]), F.col("day")).cast("int") - 1
    w = Window.partitionBy(*doc, "day_pos").orderBy("ex_pos")
    return j.select(*id_cols, "day_pos", idx.alias("weekday_idx"), "day", "focus",
                    (F.row_number().over(w) - 1).alias("ex_pos"), F.col("matched").alias("name"),
                    "sets", "reps", "rest_sec", "notes")


def current_plan(plans: DataFrame) -> DataFrame:
    """Each user's last saved plan (highest plan_id): saving replaces the
    previous plan. The plans are read once: a rank of 1 is taken in every task before
    the shuffle, so only a user's newest rows of each travel."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("plan_id"))
    kept = plans.where(F.col("user_id").isNotNull() & F.col("plan_id").isNotNull())
    return kept.withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank")


def plan_for_day(days: DataFrame, plan: DataFrame) -> DataFrame:
    """(user_id, day) -> the first plan entry whose label is the date's
    weekday: focus and number of exercises; rest days get no row."""
    from ..sources import dims
    labels = F.array(*[F.lit(d) for d in dims.WEEKDAYS])
    d = days.select("user_id", "day", F.element_at(labels, (F.dayofweek("day") + 5) % 7 + 1).alias("label"))
    entries = (plan.groupBy("user_id", "day_pos", F.col("day").alias("label"), "focus")
                   .agg(F.count("*").alias("n_exercises")))
    first = (entries.groupBy("user_id", "label")
                    .agg(F.min_by(F.struct("focus", "n_exercises"), "day_pos").alias("_e")))
    return d.join(first, ["user_id", "label"]).select("user_id", "day", "label", "_e.focus", "_e.n_exercises")


def plan_exercises_for_day(days: DataFrame, plan: DataFrame) -> DataFrame:
    """(user_id, day) -> the exercises of the first plan entry whose label is the
    date's weekday, in plan order; rest days get no rows."""
    from ..sources import dims
    labels = F.array(*[F.lit(d) for d in dims.WEEKDAYS])
    d = days.select("user_id", F.col("day").alias("date"), F.element_at(labels, (F.dayofweek("day") + 5) % 7 + 1).alias("day"))
    first = plan.groupBy("user_id", "day").agg(F.min("day_pos").alias("day_pos"))
    entry = plan.join(first, ["user_id", "day", "day_pos"])
    return d.join(entry, ["user_id", "day"]).select("user_id", F.col("date").alias("day"), F.col("day").alias("label"),
                                                    "focus", "ex_pos", "name", "sets", "reps", "rest_sec", "notes")


def day_sets(workouts: DataFrame, library: DataFrame, day) -> DataFrame:
    """One day's logged sets per user with their place in entry order; the window
    covers one user's one day."""
    w = workouts.where(F.col("day") == F.lit(day).cast("date"))
    w = w.join(F.broadcast(library.select("exercise_id", F.col("name").alias("exercise"))), "exercise_id")
    order = Window.partitionBy("user_id", "day").orderBy("entry", "exercise", "sets", "reps", "weight_kg", "rpe")
    return w.select("user_id", "day", F.row_number().over(order).alias("pos"), "exercise", "sets", "reps", "weight_kg", "rpe")


def exercise_options(days: DataFrame, plan: DataFrame) -> DataFrame:
    """(user_id, day) -> ordered exercise choices: the day's planned
    exercises first (in plan order, repeats kept), then library exercises not
    already planned, in library order. The library is a fixed 48-name
    constant array."""
    from ..sources import dims
    labels = F.array(*[F.lit(d) for d in dims.WEEKDAYS])
    d = days.select("user_id", "day", F.element_at(labels, (F.dayofweek("day") + 5) % 7 + 1).alias("label"))
    first_entry = (plan.groupBy("user_id", F.col("day").alias("label"))
                       .agg(F.min("day_pos").alias("day_pos")))
    planned = (plan.join(first_entry.withColumnRenamed("label", "day"), ["user_id", "day", "day_pos"])
                   .groupBy("user_id", F.col("day").alias("label"))
                   .agg(F.transform(F.array_sort(F.collect_list(F.struct("ex_pos", "name"))),
                                    lambda s: s["name"]).alias("planned")))
    lib = F.array(*[F.lit(n) for n, _m, _e in dims.LIBRARY])
    j = d.join(planned, ["user_id", "label"], "left")
    p = F.coalesce(F.col("planned"), F.array().cast("array<string>"))
    # Library names are distinct, so the native set difference keeps every
    # unlisted name once, in library order.
    opts = F.concat(p, F.array_except(lib, p))
    return j.select("user_id", "day", F.posexplode(opts).alias("pos", "name"))


PLAN_SCHEMA = ("array<struct<day:string,focus:string,exercises:array<struct<name:string,sets:int,reps:string,"
               "rest_sec:int,notes:string>>>>")


def plan_to_json(plan: DataFrame, id_cols=("user_id", "plan_id")) -> DataFrame:
    """Normalised plan rows -> one JSON text per plan: days in Mon..Sun order
    (stable), exercises in plan order. A plan holds at most 7 days of a few
    exercises, so collecting one plan is bounded."""
    ex = (plan.groupBy(*id_cols, "day_pos", "weekday_idx", "day", "focus")
              .agg(F.array_sort(F.collect_list(F.struct("ex_pos", "name", "sets", "reps", "rest_sec", "notes")))
                   .alias("_ex")))
    days = ex.select(*id_cols, F.struct("weekday_idx", "day_pos", "day", "focus",
                                        F.transform("_ex", lambda e: F.struct(e["name"].alias("name"), e["sets"].alias("sets"),
                                                                              e["reps"].alias("reps"),
                                                                              e["rest_sec"].alias("rest_sec"),
                                                                              e["notes"].alias("notes"))).alias("exercises"))
                     .alias("_d"))
    out = days.groupBy(*id_cols).agg(F.array_sort(F.collect_list("_d")).alias("_days"))
    clean = F.transform("_days", lambda d: F.struct(d["day"].alias("day"), d["focus"].alias("focus"),
                                                    d["exercises"].alias("exercises")))
    return out.select(*id_cols, F.to_json(clean).alias("plan_json"))


def plan_from_json(stored: DataFrame, id_cols=("user_id", "plan_id")) -> DataFrame:
    """Stored plan JSON -> rows (id_cols, day, focus, ex_pos, name, sets,
    reps, rest_sec, notes); an empty or missing plan gives no rows."""
    days = stored.select(*id_cols, F.posexplode(F.coalesce(F.from_json("plan_json", PLAN_SCHEMA),
                                                           F.array().cast(PLAN_SCHEMA))).alias("day_pos", "_d"))
    return days.select(*id_cols, "day_pos", F.col("_d.day").alias("day"), F.col("_d.focus").alias("focus"),
                       F.posexplode("_d.exercises").alias("ex_pos", "_e")).select(
        *id_cols, "day_pos", "day", "focus", "ex_pos", "_e.name", "_e.sets", "_e.reps", "_e.rest_sec", "_e.notes")
