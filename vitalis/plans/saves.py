"""Queries of what is saved and loaded: declared tables, keyed saves, deletions by
another table's keys, and the band stream."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import food, labs, snapshot
from ..sources import dims
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import oracle, queries
from .registry import ORACLE, register

# --------------------------------------------------------- declared tables

# Every seventh day a value of another type, then a text cut short, then no key.
WEIGHT_LINE_SQL = """case extract(day from day) % 7
    when 3 then '{"user_id": ' || cast(user_id as varchar) || ', "date": "' || cast(day as varchar) || '", "kg": "heavy"}'
    when 4 then '{"user_id": ' || cast(user_id as varchar) || ', "date": "' || cast(day as varchar)
    when 5 then '{"user_id": ' || cast(user_id as varchar) || ', "kg": ' || cast(kg as varchar) || '}'
    else '{"user_id": ' || cast(user_id as varchar) || ', "date": "' || cast(day as varchar) || '", "kg": ' || cast(kg as varchar) || '}'
    end"""


@register("declared_load", lambda: oracle.with_ctes(f"""
, t as (select *, extract(day from day) % 7 as v, {WEIGHT_LINE_SQL} as text from weights)
select case when v not in (3, 4, 5) then user_id end as user_id, case when v not in (3, 4, 5) then cast(day as varchar) end as date,
  case when v not in (3, 4, 5) then kg end as kg, case when v in (3, 4, 5) then text end as raw,
  case v when 3 then 'unreadable' when 4 then 'unreadable' when 5 then 'key missing' end as reason from t"""))
def q_declared_load(spark, sf_dir):
    """Weights as JSON lines in the shared folder, read back by their declared schema:
    good rows, and quarantined ones with their text and reason."""
    from ..sources import schemas
    from ..sources.storage import fresh
    root = fresh(spark, "weight-lines")
    fx.weights(spark, sf_dir).select(F.expr(WEIGHT_LINE_SQL.replace("varchar", "string")).alias("value")).write.text(root)
    good, bad = schemas.read_declared(spark, root, "weights")
    return good.unionByName(bad.withColumnRenamed("_raw", "raw"), allowMissingColumns=True)


# ------------------------------------------------------------- keyed saves


@register("save_profile", lambda: oracle.with_ctes("""
select user_id, name, case when user_id % 2 = 0 then age + 1 else age end as age, sex, height_cm, activity,
  case when user_id % 2 = 0 then null else deficit_pct end as deficit_pct, protein_g_per_kg
from profile where user_id % 3 <> 0 or user_id % 2 = 0"""))
def q_save_profile(spark, sf_dir):
    """Profiles saved again replace the whole row, nulls included; new ones are added."""
    p = fx.profile(spark, sf_dir)
    new = (p.where(F.col("user_id") % 2 == 0).withColumn("age", F.col("age") + 1)
            .withColumn("deficit_pct", F.lit(None).cast("double")))
    return snapshot.upsert_replace(p.where(F.col("user_id") % 3 != 0), new, ["user_id"])


@register("save_supplement_log", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, supplement_id, case when day(day) % 2 = 0 then 1 - taken else taken end as taken
from supplement_log where day(day) % 3 <> 0 or day(day) % 2 = 0"""))
def q_save_supplement_log(spark, sf_dir):
    """Check-offs toggled again: each (day, supplement) keeps its last state."""
    s = fx.supplement_log(spark, sf_dir)
    new = s.where(F.dayofmonth("day") % 2 == 0).withColumn("taken", 1 - F.col("taken"))
    return snapshot.upsert_replace(s.where(F.dayofmonth("day") % 3 != 0), new, ["user_id", "day", "supplement_id"])


@register("save_notes", lambda: oracle.with_ctes("""
, n as (select user_id, cast(date_trunc('week', day) as date) as week_start, arg_max(kg, day) as kg, max(day) as created
  from weights group by user_id, cast(date_trunc('week', day) as date))
select user_id, cast(week_start as varchar) as week_start, cast(created as varchar) as created,
  'Weight ' || cast(kg as varchar) || ' kg' || case when day(week_start) % 2 = 0 then ', revised' else '' end as note from n"""))
def q_save_notes(spark, sf_dir):
    """Weekly notes; the note of a week written again replaces the first one."""
    from ..functions.time import week_start
    w = fx.weights(spark, sf_dir)
    n = (w.groupBy("user_id", week_start("day").alias("week_start"))
          .agg(F.max_by("kg", "day").alias("kg"), F.max("day").alias("created")))
    notes = n.select("user_id", "week_start", "created", F.concat(F.lit("Weight "), F.col("kg").cast("string"), F.lit(" kg")).alias("note"))
    again = notes.where(F.dayofmonth("week_start") % 2 == 0).withColumn("note", F.concat("note", F.lit(", revised")))
    return snapshot.upsert_replace(notes, again, ["user_id", "week_start"])


@register("save_plan", lambda: oracle.with_ctes(queries._week_plan_sql() + """
, pl as (select user_id, plan_id, string_agg(label || ': ' || name || ' x' || cast(least(ln, 6) as varchar), '; '
    order by list_position(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], label), day_pos) as week from wp group by user_id, plan_id)
select user_id, max(plan_id) as plan_id, arg_max(week, plan_id) as week from pl group by user_id"""))
def q_save_plan(spark, sf_dir):
    """The plan of a user is the one saved last: stored JSON, upserted and read back."""
    from ..operators import workouts
    plans = workouts.plan_to_json(queries.week_plan_rows(spark, sf_dir))
    none = plans.where(F.lit(False))
    kept = snapshot.upsert_replace(none, plans.withColumn("_seq", F.col("plan_id")), ["user_id"], seq="_seq")
    line = F.concat("day", F.lit(": "), "name", F.lit(" x"), F.col("sets").cast("string"))
    return (workouts.plan_from_json(kept).withColumn("_l", line).groupBy("user_id", "plan_id")
            .agg(F.expr("listagg(_l, '; ') within group (order by day_pos, ex_pos, _l)").alias("week")))


@register("save_estimates", lambda: queries.resolve_custom_ctes() + """
, sv as (select distinct user_id, item as name, p_kcal as kcal, p_protein as protein, p_carbs as carbs, p_fat as fat
  from r6 where src = 'AI estimate')
select user_id, name, kcal, protein, carbs, fat, true as saved from sv
union all select user_id, name, kcal, protein, carbs, fat, false from cf
  where not exists (select 1 from sv where sv.user_id = cf.user_id and sv.name = cf.name)""")
def q_save_estimates(spark, sf_dir):
    """Estimated foods that were remembered, saved into the custom foods of their user."""
    ch = dims.food_choice_df(spark)
    names = fx.meal_items(spark, sf_dir, ch).select("user_id", "mention").distinct()
    custom = fx.custom_foods(spark, sf_dir)
    found = food.resolve_names(names, ch, dims.food_df(spark), custom, fx.food_estimate_table(spark, sf_dir))
    return food.save_estimates(custom, found).drop("cpos", "units")


# ---------------------------------------------- deletions, reviewed results


@register("delete_reports", lambda: oracle.with_ctes("""
select user_id, report_id, line, cast(test_date as varchar) as test_date, marker, value from lab_results
where report_id not in (select o_orderkey from orders where o_orderstatus = 'F')"""))
def q_delete_reports(spark, sf_dir):
    """Results of the reports that another table lists as withdrawn are deleted."""
    r = fx.lab_results(spark, sf_dir).select("user_id", "report_id", "line", "test_date", "marker", "value")
    gone = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]).where(F.col("o_orderstatus") == "F")
    return snapshot.delete_keys(r, gone.select(F.col("o_orderkey").alias("report_id")), ["report_id"])


@register("reviewed_results", lambda: oracle.with_ctes("""
select user_id, report_id, line, marker, value from lab_results where line % 4 <> 1 and line % 5 <> 2"""))
def q_reviewed_results(spark, sf_dir):
    """Reviewed results, some with their marker or value cleared: those are not saved."""
    r = fx.lab_results(spark, sf_dir).select(
        "user_id", "report_id", "line", F.when(F.col("line") % 4 != 1, F.col("marker")).alias("marker"),
        F.when(F.col("line") % 5 != 2, F.col("value")).alias("value"))
    return labs.drop_incomplete(r)


# ------------------------------------------------------------------ stream


@register("stream_daily", lambda: ORACLE["band_csv_parse"])
def q_stream_daily(spark, sf_dir):
    """The export files delivered to the stream in about ten batches of one import; the
    daily table as its readers see it, part of it merged."""
    from ..sources import records
    from ..sources.storage import fresh
    from ..streaming import band_stream
    root, table = fresh(spark, "stream-in"), fresh(spark, "stream-table")
    files = records.write_lines(queries.export_lines(spark, sf_dir), f"{root}/import_id=1")
    band_stream.start(spark, f"{root}/import_id=1", table_root=table, name=table.rsplit("/", 1)[-1],
                      files_per_batch=max(1, math.ceil(files / 10))).awaitTermination()
    return band_stream.latest_snapshot(spark, table)
