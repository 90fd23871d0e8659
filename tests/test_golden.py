"""Hand-computed golden rows for the scalar rules and small operators."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalis.functions.nutrition import atwater_kcal, targets, to_grams
from vitalis.functions.training import e1rm
from vitalis.operators import band, labs, weights
from vitalis.sources import dims

D = dt.date


def test_targets_male(spark):
    df = spark.createDataFrame([(75.0, 175.0, 21, "Male", "Moderate (3-5 workouts/week)", 15.0, 2.0)],
                               "w double, h double, a int, s string, act string, d double, p double")
    t = df.select(targets("w", "h", "a", "s", "act", "d", "p").alias("t")).first().t
    assert t.bmr == 1743.75
    assert t.tdee == pytest.approx(2702.8125)
    assert t.kcal == pytest.approx(2297.390625)
    assert t.protein == 150.0
    assert t.fat == pytest.approx(63.816406, rel=1e-6)
    assert t.carbs == pytest.approx(280.760742, rel=1e-6)
    assert t.floored is False


def test_targets_floored_and_unknown_activity(spark):
    df = spark.createDataFrame([(80.0, 180.0, 30, "Female", "Sedentary", 30.0, 1.6),
                                (80.0, 180.0, 30, "Female", "Unlisted", 0.0, 1.6)],
                               "w double, h double, a int, s string, act string, d double, p double")
    rows = df.select(targets("w", "h", "a", "s", "act", "d", "p").alias("t")).collect()
    assert rows[0].t.floored is True and rows[0].t.kcal == rows[0].t.bmr
    assert rows[1].t.tdee == pytest.approx(rows[1].t.bmr * 1.55)


def test_lab_flag_bounds(spark):
    df = spark.createDataFrame([(200.0, None, 200.0), (5.0, None, None), (1.0, 2.0, 0.5), (9.0, 1.0, 8.0)],
                               "v double, lo double, hi double")
    got = [r.f for r in df.select(labs.flag("v", "lo", "hi").alias("f")).collect()]
    assert got == ["In range", "In range", "Low", "High"]


def test_e1rm(spark):
    df = spark.createDataFrame([(100.0, 30), (100.0, 0), (None, 5)], "w double, r int")
    assert [r.e for r in df.select(e1rm("w", "r").alias("e")).collect()] == [200.0, 0.0, 0.0]


def test_to_grams(spark):
    food = {n: (i, {k: float(g) for k, g in u.items()}) for i, (n, *_x, u, _a) in enumerate(dims.FOODS)}
    df = spark.createDataFrame([(2.0, "katori", food["dal"][1]), (1.0, "plate", food["chicken breast"][1]),
                                (1.0, None, food["roti"][1]), (2.0, " KG ", {})],
                               "q double, u string, fu map<string,double>")
    got = [(r.g.grams, r.g.exact) for r in df.select(to_grams("q", "u", "fu").alias("g")).collect()]
    assert got == [(400.0, True), (150.0, False), (100.0, False), (2000.0, True)]


def test_atwater(spark):
    df = spark.createDataFrame([(500.0, 10.0, 10.0, 10.0), (170.0, 10.0, 10.0, 10.0), (None, -5.0, 0.0, 0.0)],
                               "k double, p double, c double, f double")
    assert [r.k for r in df.select(atwater_kcal("k", "p", "c", "f").alias("k")).collect()] == [170.0, 170.0, 0.0]


def test_rolling_7d(spark):
    w = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 2), 2.0), (1, D(2024, 1, 8), 3.0),
                               (1, D(2024, 1, 9), 4.0), (2, D(2024, 1, 1), 70.0)], "user_id long, day date, kg double")
    got = [(r.day.day, r.avg_7d) for r in weights.rolling_7d(w).orderBy("day").collect()]
    assert got == [(1, 1.0), (2, 1.5), (8, 2.5), (9, 3.5)]


def test_resting_hr_percentile(spark):
    r = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, h), float(v)) for h, v in
                               enumerate([50, 51, 52, 60, 61, 70])], "user_id long, ts timestamp_ntz, value double")
    assert band.resting_hr_daily(r).first().resting_hr == 50.25
    assert band.resting_hr_daily(r.limit(5)).count() == 0


def _daily(spark, rows):
    return spark.createDataFrame(rows, "user_id long, day date, sleep_hours double, sleep_score double, "
                                       "resting_hr double, steps long, stress double")


def test_readiness_sleep_only(spark):
    r = band.readiness(_daily(spark, [(1, D(2024, 1, 1), 8.0, None, None, None, None)])).first()
    assert r.score == 100 and r.call == dims.READY_PUSH and r.why == "slept 8.0 h"


def test_readiness_needs_three_baseline_days(spark):
    rows = [(1, D(2024, 1, d), None, None, 60.0, None, None) for d in (1, 2)]
    rows.append((1, D(2024, 1, 3), None, None, 50.0, None, 50.0))
    got = {r.day.day: r for r in band.readiness(_daily(spark, rows)).collect()}
    assert 3 in got and "resting HR" not in got[3].why and got[3].score == 50
    rows.append((1, D(2024, 1, 4), None, None, 55.0, None, None))
    got = {r.day.day: r for r in band.readiness(_daily(spark, rows)).collect()}
    assert got[4].why == "resting HR 55 vs usual 57" and got[4].score == 63


def test_readiness_stress_zero(spark):
    r = band.readiness(_daily(spark, [(1, D(2024, 1, 1), 0.0, 90.0, 0.0, None, 0.0)])).first()
    assert r.score == 100 and r.why == "stress 0"


def test_upsert_coalesce_idempotent(spark):
    old = _daily(spark, [(1, D(2024, 1, 1), 7.0, None, None, None, None)])
    new = _daily(spark, [(1, D(2024, 1, 1), None, None, None, 9, None)])
    r = band.upsert_coalesce(old, new).first()
    assert (r.sleep_hours, r.steps) == (7.0, 9)
    again = band.upsert_coalesce(band.upsert_coalesce(old, new), new).collect()
    assert [tuple(x) for x in again] == [tuple(r)]


def test_two_files_same_day_sum_then_max(spark):
    s = spark.createDataFrame([
        ("A", 1, dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 4)),
        ("A", 1, dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 14)),
        ("B", 1, dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 6))],
        "f string, user_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    merged = band.merge_daily(band.sleep_daily(s, file_col="f"))
    assert merged.first().sleep_hours == 7.0


def test_offset_and_epoch_times(spark):
    from vitalis.functions.time import offset_minutes, parse_band_time
    df = spark.createDataFrame([("UTC+0530", "1704067200000"), ("UTC-0800", "2024-01-01 10:00:00"),
                                ("UTC+05:30", "garbage"), (None, None)], "o string, t string")
    got = df.select(offset_minutes("o").alias("m"), parse_band_time("t").alias("t")).collect()
    assert [r.m for r in got] == [330, -480, 0, 0]
    assert got[0].t == dt.datetime(2024, 1, 1) and got[1].t == dt.datetime(2024, 1, 1, 10)
    assert got[2].t is None and got[3].t is None


def test_label_strip_ends_only(spark):
    from vitalis.operators.supplements import label
    df = spark.createDataFrame([("Creatine", "", "Morning"), ("Zinc", "5 mg", None)], "n string, d string, t string")
    got = [r.l for r in df.select(label(F.col("n"), F.col("d"), F.col("t")).alias("l")).collect()]
    assert got == ["Creatine ·  · Morning", "Zinc · 5 mg"]


def test_plan_json_round_trip(spark):
    from vitalis.operators import workouts
    rows = [(1, 10, 0, 3, "Thu", "Legs", 0, "Leg Press", 4, "8-10", 90, ""),
            (1, 10, 1, 0, "Mon", "Chest", 0, "Dips", 3, "10", 60, "slow"),
            (1, 10, 1, 0, "Mon", "Chest", 1, "Push-up", 2, "12", 45, "")]
    plan = spark.createDataFrame(rows, "user_id long, plan_id long, day_pos int, weekday_idx int, day string, "
                                       "focus string, ex_pos int, name string, sets int, reps string, "
                                       "rest_sec int, notes string")
    js = workouts.plan_to_json(plan)
    text = js.first().plan_json
    assert text.index('"Mon"') < text.index('"Thu"')
    back = workouts.plan_from_json(js).orderBy("day_pos", "ex_pos").collect()
    assert [(r.day, r.ex_pos, r.name) for r in back] == [("Mon", 0, "Dips"), ("Mon", 1, "Push-up"), ("Thu", 0, "Leg Press")]


def test_drop_incomplete_labs(spark):
    from vitalis.operators import labs as L
    df = spark.createDataFrame([("LDL", 1.0), (None, 2.0), ("HDL", None)], "marker string, value double")
    assert [r.marker for r in L.drop_incomplete(df).collect()] == ["LDL"]


def test_quantities_of_any_size_and_fineness(spark):
    """Four decimals are exact ties; finer and larger quantities are kept too."""
    from vitalis.functions.nutrition import total
    rows = [(0.00007, "kg", 0.07, 0.1), (1e16, "g", 1e16, 1e16), (14.85, "g", 14.85, 14.8), (0.123456, "kg", 123.456, 123.5),
            (None, "g", None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "q double, unit string")
    units = F.create_map(F.lit("serving"), F.lit(30.0))
    got = df.select(to_grams("q", "unit", units).alias("g")).collect()
    assert [r.g.grams for r in got[:-1]] == pytest.approx([r[2] for r in rows[:-1]], rel=1e-14)
    assert got[2].g.grams == 14.85 and got[-1].g.grams is None
    assert [r.g.grams_1dp for r in got] == [r[3] for r in rows]
    t = spark.createDataFrame([(29.7, 50.0), (0.00001, 1e9), (1e15, 200.0)], "per double, grams double")
    # 29.7 * 50 / 100 = 14.85, a tie.
    assert [r[0] for r in t.select(total("per", "grams")).collect()] == [14.8, 100.0, 2e15]


def test_current_plan_reads_the_plans_once(spark):
    from vitalis.operators import workouts
    plans = spark.range(6).selectExpr("if(id = 5, null, id % 2) as user_id", "id div 2 as plan_id", "id")
    now = workouts.current_plan(plans)
    assert sorted((r.user_id, r.plan_id, r.id) for r in now.collect()) == [(0, 2, 4), (1, 1, 3)]
    assert now._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_plan_names_and_rows_come_from_one_reading(spark):
    """The model's texts are parsed once, behind the shuffle that names and rows share."""
    from vitalis.operators import workouts
    from vitalis.sources import dims, model_json
    text = '{"days": [{"day": "Mon", "focus": "a", "exercises": [{"name": "%s", "sets": 2}, {"name": "no such", "sets": 9}]}]}'
    lib = dims.exercise_df(spark)
    name = lib.first().name
    out = spark.createDataFrame([(1, 7, "Full gym", text % name), (1, 7, "Full gym", text % name.upper())],
                                "user_id long, plan_id long, equipment string, text string")
    raw = model_json.plan_days(out, ["user_id", "plan_id", "equipment"], dims.WEEKDAYS)
    rows = workouts.normalise_plan(raw, workouts.allowed_exercises(lib, dims.equipment_kind_df(spark)), ["user_id", "plan_id"])
    got = rows.collect()
    assert {(r.day, r.weekday_idx, r.ex_pos, r.name, r.sets) for r in got} <= {("Mon", 0, 0, name, 2)} and got
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Generate posexplode(") == 2, final.count("Generate posexplode(")
