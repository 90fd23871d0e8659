"""Health-log input tables derived from the driver tables.

The original application keeps one user's log in a local database and ships
no sample data. These functions derive many users' logs from the parquet
tables (``customer`` -> profiles, ``lineitem`` -> food / workout / supplement
logs and lab results, ``events`` -> band readings, sleep sessions and
weights), so every operator runs on data whose size grows with the tables.

All derivations are narrow projections and filters over one scan except
``band_reading`` (a 4-way ``explode`` per event), ``weights`` (one row per
user-day) and ``supplement_log`` (one row per user-day-supplement), which
group by their key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

BASE_DAY = "2024-01-01"


def _day_from_orderkey(c):
    return F.date_add(F.lit(BASE_DAY).cast("date"), (c % 30).cast("int"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    k = F.col("c_custkey")
    activity = (F.when(k % 6 == 0, "Sedentary")
                .when(k % 6 == 1, "Light (1-3 workouts/week)")
                .when(k % 6 == 2, "Moderate (3-5 workouts/week)")
                .when(k % 6 == 3, "Very active (6-7 workouts/week)")
                .when(k % 6 == 4, "Athlete (2x/day or physical job)")
                .otherwise("Unlisted"))
    return c.select(
        k.alias("user_id"),
        F.col("c_name").alias("name"),
        (F.lit(14) + k % 77).cast("int").alias("age"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("sex"),
        (F.lit(120) + k % 111).cast("double").alias("height_cm"),
        activity.alias("activity"),
        (k % 31).cast("double").alias("deficit_pct"),
        ((F.lit(12) + k % 15).cast("double") / 10).alias("protein_g_per_kg"),
    )


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weight per (user, day): the reading of the day's highest event id."""
    e = (read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
         .where(F.col("event_type").isin("click", "view")))
    kg = ((F.lit(60) + F.col("user_id") % 40).cast("double")
          + (F.col("event_id") % 30).cast("double") / 10)
    day = F.col("ts").cast("date")
    # max_by over (user, day) is a partial aggregate: no window sort, and a
    # hot user is spread over its days.
    return (e.groupBy("user_id", day.alias("day"))
             .agg(F.max_by(kg, F.col("event_id")).alias("kg")))


def food_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    return li.select(
        F.col("l_suppkey").alias("user_id"),
        _day_from_orderkey(F.col("l_orderkey")).alias("day"),
        (F.col("l_partkey") % 61).alias("food_id"),
        (F.col("l_quantity") * 5).alias("grams"),
        F.col("l_linenumber").alias("line"),
    )


def workout_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    return (li.select(
                  F.col("l_suppkey").alias("user_id"),
                  _day_from_orderkey(F.col("l_orderkey")).alias("day"),
                  (F.col("l_partkey") % 48).alias("exercise_id"),
                  (F.lit(1) + F.col("l_linenumber") % 5).alias("sets"),
                  (F.col("l_quantity").cast("int") % 13).alias("reps"),
                  ((F.col("l_partkey") % 41).cast("double") * 2.5).alias("weight_kg"),
                  (F.lit(5.0) + (F.col("l_partkey") % 12) / 2).alias("rpe"),
                  (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entry"),
              ))


def band_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings per event, 17 minutes apart (explode, not a join)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    hr = F.col("event_type").isin("view", "click", "purchase")
    st = F.col("event_type") == "signup"
    k = F.col("k")
    return (e.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
             .select(
                 (F.col("event_id") * 4 + k).alias("reading_id"),
                 "user_id",
                 (F.col("ts") + F.make_dt_interval(mins=k * 17)).alias("ts"),
                 F.when(hr, "heart_rate").when(st, "stress").otherwise("steps").alias("metric"),
                 F.when(hr, F.lit(25) + F.col("value") + k)
                  .when(st, F.least(F.col("value"), F.lit(100.0)))
                  .otherwise(F.col("value") * 100 + k).alias("value"),
             ))


def sleep_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
         .where(F.col("event_type").isin("error", "purchase")))
    eid = F.col("event_id")
    return e.select(
        "event_id", "user_id",
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(hours=(eid % 20).cast("int"))).alias("end_time"),
        F.when(eid % 3 == 0, F.lit(None)).otherwise(F.least(F.col("value"), F.lit(100.0))).alias("sleep_score"),
        F.when(eid % 4 == 0, "UTC+0530").when(eid % 4 == 1, "UTC-0800")
         .when(eid % 4 == 2, "UTC+05:30").otherwise(F.lit(None)).alias("time_offset"),
    )


def supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's own catalogue: all parts, dealt over the users of the logs."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size", "p_type"])
    users = read_table(spark, sf_dir, "supplier", ["s_suppkey"]).agg(F.count("*").alias("n")).scalar()
    number = F.floor(F.col("p_partkey") / users).cast("long")
    return p.select(
        (F.col("p_partkey") % users + 1).alias("user_id"),
        number.alias("supplement_id"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("dose"),
        F.col("p_type").alias("timing"),
        F.when(number % 5 == 0, 0).otherwise(1).alias("active"),
    )


def supplement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"])
    return (li.select(
                F.col("l_suppkey").alias("user_id"),
                _day_from_orderkey(F.col("l_orderkey")).alias("day"),
                (F.col("l_partkey") % 12).alias("supplement_id"),
                F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("taken"))
              .groupBy("user_id", "day", "supplement_id")
              .agg(F.max("taken").alias("taken")))


def lab_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_linenumber"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    sz = F.col("p_size")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(p, F.col("l_partkey") == F.col("p_partkey"))
              .select(
                  F.col("o_custkey").alias("user_id"),
                  F.col("o_orderdate").cast("date").alias("test_date"),
                  F.col("p_type").alias("marker"),
                  F.col("l_quantity").alias("value"),
                  F.when(sz % 5 == 0, F.lit(None)).otherwise((sz % 20).cast("double")).alias("ref_low"),
                  F.when(sz % 7 == 0, F.lit(None)).otherwise((F.lit(20) + sz % 25).cast("double")).alias("ref_high"),
                  F.col("l_linenumber").alias("line"),
                  F.col("l_orderkey").alias("report_id"),
              ))



def food_mentions(spark: SparkSession, sf_dir: str, choices: DataFrame) -> DataFrame:
    """Free-text food names as a meal parser would emit them: each line item
    picks a choice string (``l_partkey % 121``) and a spelling variant by line
    number -- exact, padded upper case, plural, truncated, prefixed, noise (the
    part name) or suffixed."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    c = F.broadcast(choices.select("ord", "choice"))
    ch, ln = F.col("choice"), F.col("l_linenumber")
    mention = (F.when(ln == 1, ch)
                .when(ln == 2, F.concat(F.lit("  "), F.upper(ch), F.lit(" ")))
                .when(ln == 3, F.concat(ch, F.lit("s")))
                .when(ln == 4, F.expr("substring(choice, 1, length(choice) - 1)"))
                .when(ln == 5, F.concat(F.lit("homemade "), ch))
                .when(ln == 6, F.col("p_name"))
                .otherwise(F.concat(ch, F.lit(" fresh"))))
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
              .join(c, F.col("l_partkey") % 121 == F.col("ord"))
              .select(F.col("l_suppkey").alias("user_id"), _day_from_orderkey(F.col("l_orderkey")).alias("day"),
                      "l_orderkey", "l_linenumber", "l_quantity", mention.alias("mention")))


def exercise_mentions(spark: SparkSession, sf_dir: str, library: DataFrame) -> DataFrame:
    """Exercise names as a plan generator would emit them, per workout row:
    library name by ``l_partkey % 48``, variant by line number (exact, lower
    case, plural, truncated, tokens reversed, noise, upper case); equipment
    profile by ``l_suppkey % 3``."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    lib = F.broadcast(library.select("exercise_id", "name"))
    nm, ln = F.col("name"), F.col("l_linenumber")
    mention = (F.when(ln == 1, nm)
                .when(ln == 2, F.lower(nm))
                .when(ln == 3, F.concat(nm, F.lit("s")))
                .when(ln == 4, F.expr("substring(name, 1, length(name) - 1)"))
                .when(ln == 5, F.array_join(F.reverse(F.split(nm, " ")), " "))
                .when(ln == 6, F.col("p_name"))
                .otherwise(F.upper(nm)))
    profile = (F.when(F.col("l_suppkey") % 3 == 0, "Full gym")
                .when(F.col("l_suppkey") % 3 == 1, "Dumbbells at home").otherwise("Bodyweight only"))
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
              .join(lib, F.col("l_partkey") % 48 == F.col("exercise_id"))
              .select(F.col("l_suppkey").alias("user_id"), profile.alias("equipment"), mention.alias("mention")))


def _marker_spelling():
    t, ln = F.col("p_type"), F.col("l_linenumber")
    return (F.when(ln == 1, t)
             .when(ln == 2, F.lower(t))
             .when(ln == 3, F.concat(t, F.lit("S")))
             .when(ln == 4, F.expr("substring(p_type, 1, length(p_type) - 1)"))
             .when(ln == 5, F.initcap(t))
             .when(ln == 6, F.col("p_name"))
             .otherwise(F.concat(F.lit(" "), t, F.lit(" "))))


def marker_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker names as a report extractor would emit them, per lab row:
    variant of ``p_type`` by line number (exact, lower case, plural,
    truncated, title case, noise, padded)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_name"])
    mention = _marker_spelling()
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(p, F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("report_id"),
                      F.col("l_linenumber").alias("line"), mention.alias("mention")))


# Unit spellings a meal parser emits (legal units, synonyms, odd case and
# padding, unknown, missing); picked per line item by ``l_orderkey % 24``.
MEAL_UNITS = ["g", "ml", "kg", "l", "piece", "pcs", "katori", "bowl", "cup", "plate", "serving", None,
              "scoop", "tbsp", "slice", "handful", "glass", "can", "pack", "tsp", "Cups", " Gms ", "", "spoon"]


def meal_items(spark: SparkSession, sf_dir: str, choices: DataFrame) -> DataFrame:
    """Parsed meal items: (user_id, day, meal, meal_id, line, mention,
    quantity, unit). Quantity is half the line quantity; meal by order key."""
    from . import dims
    m = food_mentions(spark, sf_dir, choices)
    units = F.array(*[F.lit(u) for u in MEAL_UNITS])
    meals = F.array(*[F.lit(x) for x in dims.MEALS])
    return m.select(
        "user_id", "day",
        F.element_at(meals, (F.col("l_orderkey") % len(dims.MEALS) + 1).cast("int")).alias("meal"),
        F.col("l_orderkey").alias("meal_id"), F.col("l_linenumber").alias("line"), "mention",
        (F.col("l_quantity") / 2).alias("quantity"),
        F.element_at(units, (F.col("l_orderkey") % len(MEAL_UNITS) + 1).cast("int")).alias("unit"))


def chunk_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per report chunk (order, line) the test date a report extractor would
    return: empty on every third chunk, else the order date plus the line."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    ln = F.col("l_linenumber")
    td = F.when(ln % 3 == 1, F.lit("")).otherwise(
        F.date_add(F.col("o_orderdate").cast("date"), ln.cast("int")).cast("string"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .select(F.col("l_orderkey").alias("report_id"), ln.alias("chunk"), td.alias("test_date")))


def lab_extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted result rows of each report (order): chunk = (line - 1) div 4,
    position = line, the marker spelling of ``marker_mentions`` and the value."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_name"])
    ln = F.col("l_linenumber")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(p, F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("report_id"),
                      ((ln - 1) / 4).cast("int").alias("chunk"), ln.alias("pos"), _marker_spelling().alias("mention"),
                      F.col("l_quantity").alias("value")))


def meal_outputs(spark: SparkSession, sf_dir: str, choices: DataFrame) -> DataFrame:
    """Meal-parser output text per line item, clean or damaged by
    ``l_orderkey % 6``: clean; wrapped in prose; null unit; quantity as text
    (unparsable on line 3); an item without a name plus one with quantity 0
    and empty unit; not JSON at all on odd lines, else quantity true and a
    numeric unit."""
    from . import dims
    m = food_mentions(spark, sf_dir, choices)
    units = F.array(*[F.lit(u) for u in dims.UNITS])
    q = (F.col("l_quantity") / 2).cast("string")
    u = F.element_at(units, (F.col("l_orderkey") % len(dims.UNITS) + 1).cast("int"))
    name = F.col("mention")
    item = F.concat(F.lit('{"name": "'), name, F.lit('", "quantity": '), q, F.lit(', "unit": "'), u, F.lit('"}'))
    v = F.col("l_orderkey") % 6
    ln = F.col("l_linenumber")
    text = (F.when(v == 0, F.concat(F.lit('{"items": ['), item, F.lit("]}")))
             .when(v == 1, F.concat(F.lit('Sure, here you go: {"items": ['), item, F.lit("]} Enjoy!")))
             .when(v == 2, F.concat(F.lit('{"items": [{"name": "'), name, F.lit('", "quantity": '), q,
                                    F.lit(', "unit": null}]}')))
             .when(v == 3, F.concat(F.lit('{"items": [{"name": "'), name, F.lit('", "quantity": "'),
                                    F.when(ln == 3, F.lit("two")).otherwise(q), F.lit('", "unit": "'), u,
                                    F.lit('"}]}')))
             .when(v == 4, F.concat(F.lit('{"items": [{"quantity": '), q, F.lit(', "unit": "'), u,
                                    F.lit('"}, {"name": "'), name, F.lit('", "quantity": 0, "unit": ""}]}')))
             .when(ln % 2 == 1, F.lit("Sorry, I could not read that meal."))
             .otherwise(F.concat(F.lit('{"items": [{"name": "'), name, F.lit('", "quantity": true, "unit": 5}]}'))))
    return m.select("user_id", F.col("l_orderkey").alias("meal_id"), F.col("l_linenumber").alias("line"),
                    text.alias("text"))


def lab_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report-extractor output text per report chunk (line item), clean or
    damaged by ``(l_orderkey + l_linenumber) % 6``: clean; prose around a text
    value and an unusable bound; null date, a null marker, padded marker and null
    unit; no date, a value in words, value true and a numeric unit; empty date and
    no results, not JSON at all on odd lines; an item without marker, a null value,
    a text bound."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    ln = F.col("l_linenumber")
    date = F.concat(F.lit('"test_date": "'), F.date_add(F.col("o_orderdate").cast("date"), ln.cast("int")).cast("string"),
                    F.lit('"'))
    q, m = F.col("l_quantity").cast("string"), F.concat(F.lit('"marker": "'), F.col("p_type"), F.lit('"'))
    v = (F.col("l_orderkey") + ln) % 6
    text = (F.when(v == 0, F.concat(F.lit("{"), date, F.lit(', "results": [{'), m, F.lit(', "value": '), q,
                                    F.lit(', "unit": "mg/dL", "ref_low": 1, "ref_high": 30}]}')))
             .when(v == 1, F.concat(F.lit("Here it is: {"), date, F.lit(', "results": [{'), m, F.lit(', "value": " '), q,
                                    F.lit(' ", "unit": "mg/dL", "ref_low": "n/a", "ref_high": 30.5}]} Done.')))
             .when(v == 2, F.concat(F.lit('{"test_date": null, "results": [{"marker": null, "value": 3}, {"marker": " \\t'),
                                    F.col("p_type"), F.lit(' ", "value": '), q, F.lit(', "unit": null}]}')))
             .when(v == 3, F.concat(F.lit('{"results": [{'), m, F.lit(', "value": "high"}, {'), m,
                                    F.lit(', "value": true, "unit": 5}]}')))
             .when((v == 4) & (ln % 2 == 1), F.lit("No table on this page."))
             .when(v == 4, F.lit('{"test_date": "", "results": []}'))
             .otherwise(F.concat(F.lit("{"), date, F.lit(', "results": [{"value": 1}, {'), m, F.lit(', "value": null}, {'), m,
                                 F.lit(', "value": '), q, F.lit(', "ref_low": "2.5", "ref_high": null}]}'))))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("l_orderkey").alias("report_id"), ln.alias("chunk"), text.alias("text")))


def estimate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Food-estimate output text per part, clean or damaged by
    ``p_partkey % 5``: clean; negative fat and a text unit; missing kcal with
    out-of-range units; prose around text kcal and null protein; kcal far
    from the macros."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    s = F.col("p_size")
    K, P, C, Fa = (s * 10).cast("string"), (s % 30).cast("string"), (s % 45).cast("string"), (s % 20).cast("string")
    v = F.col("p_partkey") % 5
    text = (F.when(v == 0, F.concat(F.lit('{"kcal": '), K, F.lit(', "protein": '), P, F.lit(', "carbs": '), C,
                                    F.lit(', "fat": '), Fa, F.lit(', "units": {"piece": '), s.cast("string"),
                                    F.lit(', "serving": 100}}')))
             .when(v == 1, F.concat(F.lit('{"kcal": '), K, F.lit(', "protein": '), P, F.lit(', "carbs": '), C,
                                    F.lit(', "fat": -3, "units": {"piece": "50", "cup": 240}}')))
             .when(v == 2, F.concat(F.lit('{"protein": '), P, F.lit(', "carbs": '), C, F.lit(', "fat": '), Fa,
                                    F.lit(', "units": {"pack": 2500, "slice": 0}}')))
             .when(v == 3, F.concat(F.lit('Here: {"kcal": "'), K, F.lit('", "protein": null, "carbs": '), C,
                                    F.lit(', "fat": '), Fa, F.lit("} thanks")))
             .otherwise(F.concat(F.lit('{"kcal": '), (s * 30).cast("string"), F.lit(', "protein": '), P,
                                 F.lit(', "carbs": '), C, F.lit(', "fat": '), Fa, F.lit(', "units": {"bowl": '),
                                 (s * 7.5).cast("string"), F.lit("}}"))))
    return p.select("p_partkey", F.col("p_name").alias("name"), text.alias("text"))


def band_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export CSV lines (file, user_id, line_no, text) per user: a sleep
    file, a heart-rate file, two step files (readings of even and of odd number,
    as ``count`` and as ``step_count``), a stress file and an ignored sleep-stage
    file.

    Sleep file variant by ``user_id % 4``: 0 metadata line + header, text
    times; 1 no metadata line, epoch-millisecond times; 2 BOM, metadata,
    header with a repeated start_time and a trailing extra field on every
    line; 3 no end_time column (the file yields nothing).
    """
    from pyspark.sql import Window
    s = sleep_session(spark, sf_dir)
    v = F.col("user_id") % 4
    ms = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("long").cast("string")
    txt = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSS")
    score = F.coalesce(F.col("sleep_score").cast("string"), F.lit(""))
    off = F.coalesce(F.col("time_offset"), F.lit(""))
    pre = "com.samsung.health.sleep."
    header = (F.when(v == 2, F.lit(f"{pre}start_time,{pre}end_time,{pre}sleep_score,{pre}time_offset,{pre}start_time"))
               .when(v == 3, F.lit(f"{pre}start_time,{pre}sleep_score,{pre}time_offset"))
               .otherwise(F.lit(f"{pre}start_time,{pre}end_time,{pre}sleep_score,{pre}time_offset")))
    data = (F.when(v == 1, F.concat_ws(",", ms("start_time"), ms("end_time"), score, off))
             .when(v == 2, F.concat_ws(",", txt("start_time"), txt("end_time"), score, off, F.lit("x")))
             .when(v == 3, F.concat_ws(",", txt("start_time"), score, off))
             .otherwise(F.concat_ws(",", txt("start_time"), txt("end_time"), score, off)))
    sleep_file = F.concat(F.lit("export/user_id="), F.col("user_id").cast("string"),
                          F.lit("/com.samsung.shealth.sleep.csv"))
    stage_file = F.concat(F.lit("export/user_id="), F.col("user_id").cast("string"),
                          F.lit("/com.samsung.shealth.sleep_stage.csv"))
    has_meta = v != 1
    sd = s.select("user_id", F.col("event_id").alias("_o"), sleep_file.alias("file"), data.alias("text"),
                  header.alias("_h"), has_meta.alias("_m"))
    stage = s.select("user_id", F.col("event_id").alias("_o"), stage_file.alias("file"),
                     F.concat_ws(",", txt("start_time"), txt("end_time"), score, off).alias("text"),
                     F.lit(f"{pre}start_time,{pre}end_time,{pre}sleep_score,{pre}time_offset").alias("_h"),
                     F.lit(True).alias("_m"))
    every = band_reading(spark, sf_dir)
    r = every.where(F.col("metric") == "heart_rate")
    hp = "com.samsung.health.heart_rate."
    heart = r.select("user_id", F.col("reading_id").alias("_o"),
                     F.concat(F.lit("export/user_id="), F.col("user_id").cast("string"),
                              F.lit("/com.samsung.shealth.tracker.heart_rate.csv")).alias("file"),
                     F.concat_ws(",", txt("ts"), F.col("value").cast("string"), F.lit("")).alias("text"),
                     F.lit(f"{hp}start_time,{hp}heart_rate,{hp}time_offset").alias("_h"), F.lit(True).alias("_m"))

    def readings(metric, odd, name, header):
        keep = (F.col("metric") == metric) & (F.lit(True) if odd is None else F.col("reading_id") % 2 == odd)
        return every.where(keep).select(
            "user_id", F.col("reading_id").alias("_o"),
            F.concat(F.lit("export/user_id="), F.col("user_id").cast("string"), F.lit(f"/{name}")).alias("file"),
            F.concat_ws(",", txt("ts"), F.col("value").cast("string"), F.lit("")).alias("text"),
            F.lit(header).alias("_h"), F.lit(True).alias("_m"))

    body = (sd.unionByName(stage).unionByName(heart)
              .unionByName(readings("steps", 0, "com.samsung.shealth.step_daily_trend.csv", "day_time,count,time_offset"))
              .unionByName(readings("steps", 1, "com.samsung.shealth.tracker.pedometer_day_summary.csv",
                                    "day_time,step_count,time_offset"))
              .unionByName(readings("stress", None, "com.samsung.shealth.stress.csv", "start_time,score,time_offset")))
    w = Window.partitionBy("file").orderBy("_o")
    body = body.withColumn("_rn", F.row_number().over(w))
    # The lines before a file's first reading come with it: one window for all, and every
    # line of a file stands where the others do.
    first, meta = F.col("_rn") == 1, F.col("_m")
    bom = F.when((F.col("user_id") % 4 == 2) & F.col("file").endswith("sleep.csv"), F.lit("﻿")).otherwise(F.lit(""))

    def line(number, value):
        return F.struct(number.cast("int").alias("line_no"), value.alias("text"))
    row = line(F.when(meta, F.col("_rn") + 1).otherwise(F.col("_rn")), F.col("text"))
    lines = (F.when(first & meta, F.array(line(F.lit(0), F.concat(bom, F.lit("com.samsung.shealth.export,6313"))),
                                          line(F.lit(1), F.col("_h")), row))
              .when(first, F.array(line(F.lit(0), F.concat(bom, F.col("_h"))), row)).otherwise(F.array(row)))
    return body.select("file", "user_id", F.inline(lines))


REQUESTED_DAYS = ["Mon", "Tue", "Thu", "Fri", "Sat"]


def plan_outputs(spark: SparkSession, sf_dir: str, library: DataFrame) -> DataFrame:
    """Plan-generator output text per workout row: one day (the weekday of
    the row's date) with the row's exercise spelling and an exercise outside
    the library. Field variants by ``l_orderkey % 5``: clean; text sets,
    numeric reps, text rest; unusable sets, missing reps, null rest and
    notes; day forced to Sun; fractional sets and zero rest."""
    from . import dims
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type"])
    lib = F.broadcast(library.select("exercise_id", "name"))
    nm, ln = F.col("name"), F.col("l_linenumber")
    mention = (F.when(ln == 1, nm).when(ln == 2, F.lower(nm)).when(ln == 3, F.concat(nm, F.lit("s")))
                .when(ln == 4, F.expr("substring(name, 1, length(name) - 1)"))
                .when(ln == 5, F.array_join(F.reverse(F.split(nm, " ")), " "))
                .when(ln == 6, F.col("p_name")).otherwise(F.upper(nm)))
    day = _day_from_orderkey(F.col("l_orderkey"))
    labels = F.array(*[F.lit(d) for d in dims.WEEKDAYS])
    label = F.element_at(labels, (F.dayofweek(day) + 5) % 7 + 1)
    v = F.col("l_orderkey") % 5
    label = F.when(v == 3, F.lit("Sun")).otherwise(label)
    sets = (F.when(v == 0, (ln + 2).cast("string")).when(v == 1, F.lit('"4"')).when(v == 2, F.lit('"heavy"'))
             .when(v == 3, F.lit("3")).otherwise(F.lit("9.7")))
    rest = (F.when(v == 0, F.lit(', "rest_sec": 120')).when(v == 1, F.lit(', "rest_sec": "90 sec"'))
             .when(v == 2, F.lit(', "rest_sec": null')).when(v == 3, F.lit(', "rest_sec": 60'))
             .otherwise(F.lit(', "rest_sec": 0')))
    reps = (F.when(v == 1, F.lit(', "reps": 10')).when(v == 2, F.lit("")).otherwise(F.lit(', "reps": "8-10"')))
    notes = (F.when(v == 0, F.lit(', "notes": "go"')).when(v == 2, F.lit(', "notes": null')).otherwise(F.lit("")))
    ex = F.concat(F.lit('{"name": "'), mention, F.lit('", "sets": '), sets, reps, rest, notes, F.lit("}"))
    text = F.concat(F.lit('{"days": [{"day": "'), label, F.lit('", "focus": "'), F.col("p_type"),
                    F.lit('", "exercises": ['), ex, F.lit(', {"name": "Mystery Move", "sets": 3}]}]}'))
    profile = (F.when(F.col("l_suppkey") % 3 == 0, "Full gym")
                .when(F.col("l_suppkey") % 3 == 1, "Dumbbells at home").otherwise("Bodyweight only"))
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
              .join(lib, F.col("l_partkey") % 48 == F.col("exercise_id"))
              .select(F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") * 8 + ln).alias("plan_id"),
                      profile.alias("equipment"), text.alias("text")))


def food_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates of all parts: (p_partkey, name, kcal, protein, carbs, fat, units). A
    table of parts is a few files of short rows, and reading one estimate is much work:
    the texts are dealt over tasks before, and the rows after, so that a query that needs
    them twice shares them."""
    from . import model_json
    out = estimate_outputs(spark, sf_dir)
    return model_json.food_estimates(out.repartition("p_partkey"), ["p_partkey", "name"]).repartition("p_partkey", "name")


def custom_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foods users saved from estimates: (user_id, name, cpos, kcal, protein,
    carbs, fat, units). Every tenth part is saved under a built-in key or
    alias (choice ``(p_partkey * 7) % 121``), overriding it; the rest under
    the lower-cased part name. The parts are dealt over all users (suppliers);
    saving a name again replaces it (highest part key wins); ``cpos`` is the
    save order."""
    from . import dims
    est = food_estimates(spark, sf_dir)
    ch = F.broadcast(dims.food_choice_df(spark).select(F.col("ord").alias("_o"), F.col("choice").alias("_c")))
    e = est.join(ch, (F.col("p_partkey") * 7) % 121 == F.col("_o"), "left")
    nm = F.when(F.col("p_partkey") % 10 == 0, F.col("_c")).otherwise(F.lower("name"))
    users = read_table(spark, sf_dir, "supplier", ["s_suppkey"]).agg(F.count("*").alias("n")).scalar()
    rows = e.select((F.col("p_partkey") % users + 1).alias("user_id"), nm.alias("cname"), "p_partkey", "kcal", "protein",
                    "carbs", "fat", "units")
    best = (rows.groupBy("user_id", "cname")
                .agg(F.max_by(F.struct("p_partkey", "kcal", "protein", "carbs", "fat", "units"), "p_partkey").alias("r")))
    return best.select("user_id", F.col("cname").alias("name"), F.col("r.p_partkey").alias("cpos"),
                       "r.kcal", "r.protein", "r.carbs", "r.fat", "r.units")


def food_estimate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates available for unmatched names: (name_key, kcal, protein,
    carbs, fat, units), one per lower-cased part name (lowest part key)."""
    est = food_estimates(spark, sf_dir)
    return (est.groupBy(F.lower("name").alias("name_key"))
               .agg(F.min_by(F.struct("kcal", "protein", "carbs", "fat", "units"), "p_partkey").alias("r"))
               .select("name_key", "r.*"))


def week_plan_outputs(spark: SparkSession, sf_dir: str, library: DataFrame) -> DataFrame:
    """Plan-generator output text per order: one day entry per line (at most 7),
    the weekday by ``(l_orderkey + 3 * l_linenumber) % 7`` so that days are out of
    order, with the line's exercise in the spelling of ``exercise_mentions``."""
    from . import dims
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type"])
    lib = F.broadcast(library.select("exercise_id", "name"))
    nm, ln = F.col("name"), F.col("l_linenumber")
    mention = F.when(ln % 3 == 0, F.upper(nm)).when(ln % 3 == 1, F.concat(nm, F.lit("s"))).otherwise(nm)
    label = F.element_at(F.array(*[F.lit(d) for d in dims.WEEKDAYS]), ((F.col("l_orderkey") + 3 * ln) % 7 + 1).cast("int"))
    day = F.concat(F.lit('{"day": "'), label, F.lit('", "focus": "'), F.col("p_type"), F.lit('", "exercises": [{"name": "'),
                   mention, F.lit('", "sets": '), ln.cast("string"), F.lit("}]}"))
    user = F.col("o_custkey")
    profile = (F.when(user % 3 == 0, "Full gym").when(user % 3 == 1, "Dumbbells at home").otherwise("Bodyweight only"))
    rows = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
              .join(lib, F.col("l_partkey") % 48 == F.col("exercise_id"))
              .groupBy(user.alias("user_id"), F.col("l_orderkey").alias("plan_id"), profile.alias("equipment"))
              .agg(F.array_sort(F.collect_list(F.struct(ln.alias("ln"), day.alias("day")))).alias("days")))
    return rows.select("user_id", "plan_id", "equipment", F.concat(F.lit('{"days": ['), F.array_join("days.day", ", "),
                                                                  F.lit("]}")).alias("text"))
