"""Band CSV lines and model JSON cleaning on small hand-made inputs."""
from pyspark.sql import functions as F

from vitalis.sources import band_csv, model_json


def test_route(spark):
    names = ["x/com.samsung.shealth.sleep.123.csv", "x/com.samsung.shealth.sleep_stage.csv",
             "com.samsung.health.sleep_combined.csv", "a/com.samsung.shealth.tracker.heart_rate.csv",
             "heart_rate_recovery.csv", "step_daily_trend.csv", "pedometer_day_summary.csv",
             "stress.csv", "stress_histogram.csv", "weight.csv", "Sleep_GOAL.csv", "sleep_heart_rate.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r.k for r in df.select(band_csv.route("f").alias("k")).collect()]
    assert got == ["sleep", None, None, "heart", None, "steps", "steps", "stress", None, None, None, "sleep"]


def _lines(spark, files):
    rows = []
    for f, uid, lines in files:
        for i, t in enumerate(lines):
            rows.append((f, uid, min(i, 2), t))
    return spark.createDataFrame(rows, "file string, user_id long, line_no int, text string")


def test_header_rules_and_required_columns(spark):
    p = "com.samsung.health.sleep."
    files = [
        ("u/sleep.csv", 1, ["meta,1", f"{p}start_time,{p}end_time,{p}sleep_score",
                            "2024-01-01 22:00:00,2024-01-02 05:00:00,80", "2024-01-02 13:00:00,2024-01-02 14:00:00,"]),
        ("u/sleep2.csv", 1, [f"﻿{p}start_time,{p}end_time,{p}start_time", "1704146400000,1704171600000,5"]),
        ("u/sleep3.csv", 2, ["meta,1", f"{p}start_time,{p}sleep_score", "2024-01-01 22:00:00,80"]),
        ("u/sleep4.csv", 3, ["only one line"]),
    ]
    d = {(r.user_id, str(r.day)): r for r in band_csv.daily_from_lines(_lines(spark, files)).collect()}
    # file 1: 7 h + 1 h on Jan 2; file 2: 7 h on Jan 2 -> max(8, 7) = 8
    assert d[(1, "2024-01-02")].sleep_hours == 8.0
    assert d[(1, "2024-01-02")].sleep_score == 80.0
    assert (2, "2024-01-01") not in d and (3, "2024-01-01") not in d


def test_meal_json(spark):
    texts = ['{"items": [{"name": " egg ", "quantity": 2, "unit": "piece"}]}',
             'Sure! {"items": [{"name": "dal", "quantity": "1.5", "unit": null}]} ok',
             '{"items": [{"quantity": 1}, {"name": "tea", "quantity": 0, "unit": ""}, {"name": "x", "quantity": "lots"}]}',
             'not json', '{"items": [{"name": null, "quantity": true, "unit": 5}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r.id, r.name, r.quantity, r.unit) for r in model_json.meal_items(df, ["id"]).orderBy("id", "item_pos").collect()]
    assert got == [(0, "egg", 2.0, "piece"), (1, "dal", 1.5, "serving"), (2, "tea", 1.0, "serving"),
                   (4, "None", 1.0, "5")]
    st = [r.s for r in df.select(model_json.parse_status("text").alias("s")).orderBy("id").collect()]
    assert st == ["parsed", "repaired", "parsed", "rejected", "parsed"]


def test_food_estimate_units(spark):
    df = spark.createDataFrame([(1, '{"kcal": 500, "protein": 10, "carbs": 10, "fat": 10, '
                                    '"units": {"piece": "50", "cup": 240, "big": 2500, "zero": 0}}')],
                               "id int, text string")
    r = model_json.food_estimates(df, ["id"]).first()
    assert r.kcal == 170.0 and dict(r.units) == {"cup": 240.0}
    assert F is not None


def test_header_join_same_result_with_and_without_broadcast(spark):
    """Whichever join Spark picks for the header table, the rows are the same."""
    p = "com.samsung.health.sleep."
    h = "com.samsung.health.heart_rate."
    files = [
        ("u/sleep.csv", 1, ["meta,1", f"{p}start_time,{p}end_time,{p}sleep_score,{p}time_offset",
                            "2024-01-01 22:00:00,2024-01-02 05:00:00,80,UTC+0100",
                            "2024-01-02 22:00:00,2024-01-03 06:30:00,,UTC-0800"]),
        ("v/heart_rate.csv", 2, [f"{h}start_time,{h}heart_rate"]
         + [f"2024-01-01 0{i}:00:00,{50 + i}" for i in range(8)]),
    ]
    lines = _lines(spark, files)
    cols = ["user_id", "day", "sleep_hours", "sleep_score", "resting_hr", "steps", "stress"]
    broadcast_rows = sorted(band_csv.daily_from_lines(lines).select(*cols).collect())
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = band_csv.daily_from_lines(lines).select(*cols)
        assert sorted(shuffled.collect()) == broadcast_rows
        assert "BroadcastExchange" not in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    # both sleep sessions wake on Jan 2 after the offsets (7 h + 8.5 h); eight heart readings on Jan 1
    assert [(r.user_id, str(r.day), r.sleep_hours, r.resting_hr) for r in broadcast_rows] == \
        [(1, "2024-01-02", 15.5, None), (2, "2024-01-01", None, 50.35)]


def test_bad_numbers_and_times_are_missing(spark):
    """NaN, infinity, oversized numbers and epochs, tabs around fields: missing
    or trimmed, never an error (T1, T6, T12)."""
    p = "com.samsung.health.step_daily_trend."
    bad = ["nan", "inf", "-Infinity", "1e400", "abc", ""]
    files = [("u/step_daily_trend.csv", 1, ["meta,1", f"{p}day_time,{p}count"]
              + [f"2024-01-01 01:00:00,{b}" for b in bad] + ["\t2024-01-01 02:00:00 ,\t4200 ", "9" * 25 + ",5", "9" * 18 + ",5"])]
    rows = band_csv.daily_from_lines(_lines(spark, files)).collect()
    assert all(r.steps in (None, 4200) for r in rows)


def test_bad_values_do_not_end_a_job(spark):
    from vitalis.functions import expr, nutrition
    from vitalis.functions.time import parse_band_time
    from vitalis.operators import labs
    df = spark.createDataFrame([("nan", float("nan")), ("1e16", 1e16), ("9" * 25, float("inf")), ("9" * 18, -1.0), ("\tg\n", 2.0)],
                               "s string, v double")
    got = df.select(expr.finite_number("s").alias("n"), parse_band_time("s").alias("t"), expr.strip("s").alias("x"),
                    labs.flag("v", F.lit(0.0), F.lit(10.0)).alias("f"), nutrition.dec("v").alias("d")).collect()
    assert [r.n for r in got[:2]] == [None, 1e16] and got[2].t is None and got[3].t is None
    assert got[4].x == "g" and [r.f for r in got] == ["In range", "High", "High", "Low", "In range"]
    grams = df.where("v = 2").select(nutrition.to_grams(F.lit(50.0), F.lit("g\n"), F.create_map(F.lit("cup"), F.lit(1.0))).alias("g"))
    assert grams.first().g.grams == 50.0
    assert df.agg(expr.exact_sum("v").alias("s")).first().s is not None


def test_lab_items_and_report_date(spark):
    from vitalis.operators import labs
    from vitalis.sources import model_json
    rows = [(1, 0, '{"test_date": null, "results": [{"marker": " \\tHDL\\n", "value": " 41 ", "unit": null, "ref_low": "40"}]}'),
            (1, 1, 'x {"test_date": "2024-02-01", "results": [{"marker": "", "value": 1}, {"marker": "LDL", "value": "nan"}]} y'),
            (1, 2, '{"test_date": "2024-03-01", "results": [{"marker": 12, "value": true, "unit": "u", "ref_high": [1]}]}'),
            (2, 0, "not json"), (2, 1, None), (3, 0, '{"test_date": "", "results": {"a": 1}}')]
    df = spark.createDataFrame(rows, "report_id int, chunk int, text string")
    got = [tuple(r) for r in model_json.lab_items(df, ["report_id", "chunk"]).orderBy("report_id", "chunk").collect()]
    assert got == [(1, 0, 0, "HDL", 41.0, "", 40.0, None), (1, 2, 0, "12", 1.0, "u", None, None)]
    dates = labs.report_date(model_json.lab_reports(df, ["report_id", "chunk"])).collect()
    assert [tuple(r) for r in dates] == [(1, "2024-02-01")]


def test_upsert_takes_the_last_write(spark):
    from vitalis.operators import snapshot
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(1, 5.0, 2), (1, 9.0, 1), (3, 3.0, 1)], "k int, v double, n int")
    got = sorted(tuple(r) for r in snapshot.upsert_replace(old, new, ["k"], seq="n").collect())
    assert got == [(1, 5.0), (2, 2.0), (3, 3.0)]


def test_json_values_are_read_in_two_views(spark):
    """A value's type and text are extracted, its number, truth and emptiness derived."""
    from vitalis.sources import model_json
    rows = [(1, '{"results": [{"marker": [], "value": 1}, {"marker": "a", "value": true, "unit": {}}, '
                '{"marker": 5, "value": " 2.5 ", "unit": [0], "ref_low": 1e400}, {"marker": {}, "value": 3}]}')]
    out = model_json.lab_items(spark.createDataFrame(rows, "id int, text string"), ["id"])
    assert [(r.item_pos, r.marker, r.value, r.unit, r.ref_low) for r in out.sort("item_pos").collect()] == \
        [(1, "a", 1.0, "", None), (2, "5", 2.5, "[0]", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") <= 1 + 4 * 5  # the type names its value twice
