"""Query definitions registered with ``registry``: Spark plan + oracle SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nutrition import targets as targets_expr
from ..operators import band, food, weights
from ..sources import dims
from ..sources import fixtures as fx
from . import oracle, weekly
from .registry import ORACLE, register

# ------------------------------------------------------------------ band


def band_daily(spark, sf_dir):
    return band.band_daily_from_readings(fx.band_reading(spark, sf_dir), fx.sleep_session(spark, sf_dir))


@register("sleep_daily", lambda: oracle.with_ctes(
    "select user_id, cast(day as varchar) as day, sleep_hours, sleep_score from sleep_daily"))
def q_sleep_daily(spark, sf_dir):
    return band.sleep_daily(fx.sleep_session(spark, sf_dir))


@register("resting_hr_daily", lambda: oracle.with_ctes("select user_id, cast(day as varchar) as day, resting_hr from heart_daily"))
def q_resting_hr(spark, sf_dir):
    r = fx.band_reading(spark, sf_dir)
    return band.resting_hr_daily(r.where(F.col("metric") == "heart_rate"))


@register("steps_daily", lambda: oracle.with_ctes("select user_id, cast(day as varchar) as day, steps from steps_daily"))
def q_steps(spark, sf_dir):
    r = fx.band_reading(spark, sf_dir)
    return band.steps_daily(r.where(F.col("metric") == "steps"))


@register("stress_daily", lambda: oracle.with_ctes("select user_id, cast(day as varchar) as day, stress from stress_daily"))
def q_stress(spark, sf_dir):
    r = fx.band_reading(spark, sf_dir)
    return band.stress_daily(r.where(F.col("metric") == "stress"))


@register("band_daily", lambda: oracle.with_ctes(
    "select user_id, cast(day as varchar) as day, sleep_hours, sleep_score, resting_hr, steps, stress from band_daily"))
def q_band_daily(spark, sf_dir):
    return band_daily(spark, sf_dir)


READINESS_SQL = """
, b as (
  select d.*,
    count(resting_hr) over w as bn,
    sum(cast(resting_hr as decimal(18,4))) over w as bs
  from band_daily d
  window w as (partition by user_id order by day range between interval 14 days preceding and interval 1 day preceding)),
p as (
  select user_id, day, sleep_hours, resting_hr, stress,
    case when bn > 0 then cast(bs as double) / bn end as base,
    case when sleep_hours is not null and sleep_hours <> 0 then
      case when sleep_score is not null and sleep_score <> 0
        then 0.5 * greatest(0.0, least(1.0, sleep_hours / 8)) + 0.5 * greatest(0.0, least(1.0, sleep_score / 100))
        else greatest(0.0, least(1.0, sleep_hours / 8)) end end as sp,
    case when resting_hr is not null and resting_hr <> 0 and bn >= 3 then
      greatest(0.0, least(1.0, 0.5 + (cast(bs as double) / bn - resting_hr) * 0.08)) end as hp,
    case when stress is not null then greatest(0.0, least(1.0, 1 - stress / 100)) end as tp
  from b),
s as (
  select *, 0.0 + coalesce(sp * 0.5, 0.0) + coalesce(hp * 0.3, 0.0) + coalesce(tp * 0.2, 0.0) as num,
    0.0 + case when sp is not null then 0.5 else 0.0 end + case when hp is not null then 0.3 else 0.0 end
        + case when tp is not null then 0.2 else 0.0 end as den
  from p)
select user_id, cast(day as varchar) as day, cast(round_even(100 * num / den, 0) as int) as score,
  case when round_even(100 * num / den, 0) >= 75 then '{push}'
       when round_even(100 * num / den, 0) >= 55 then '{plan}' else '{light}' end as call,
  concat_ws(', ',
    case when sp is not null then printf('slept %.1f h', round_even(sleep_hours, 1)) end,
    case when hp is not null then printf('resting HR %d vs usual %d', cast(round_even(resting_hr, 0) as bigint),
                                         cast(round_even(base, 0) as bigint)) end,
    case when tp is not null then printf('stress %d', cast(round_even(stress, 0) as bigint)) end) as why
from s where den > 0
""".replace("{push}", dims.READY_PUSH).replace("{plan}", dims.READY_PLAN).replace("{light}", dims.READY_LIGHT)


@register("readiness", lambda: oracle.with_ctes(READINESS_SQL))
def q_readiness(spark, sf_dir):
    return band.readiness(band_daily(spark, sf_dir))


# ------------------------------------------------------------ nutrition


@register("targets", lambda: oracle.with_ctes(f"""
, lw as (select user_id, arg_max(kg, day) as kg from weights group by user_id)
select p.user_id, {oracle.targets_cols('lw.kg')}
from profile p join lw on lw.user_id = p.user_id left join activity_dim a on a.activity = p.activity"""))
def q_targets(spark, sf_dir):
    """Targets from each user's profile and latest weight (users lacking
    either get none)."""
    lw = weights.latest(fx.weights(spark, sf_dir))
    j = fx.profile(spark, sf_dir).join(lw.select("user_id", "kg"), "user_id")
    t = targets_expr("kg", "height_cm", "age", "sex", "activity", "deficit_pct", "protein_g_per_kg")
    return j.select("user_id", t["bmr"].alias("bmr"), t["tdee"].alias("tdee"), t["kcal"].alias("kcal"),
                    t["protein"].alias("protein"), t["carbs"].alias("carbs"), t["fat"].alias("fat"),
                    t["floored"].alias("floored"))


def food_rows(spark, sf_dir):
    return food.enrich_food_log(fx.food_log(spark, sf_dir), dims.food_df(spark))


# --------------------------------------------------------------- weekly


@register("week_stats", oracle.week_stats_sql)
def q_week_stats(spark, sf_dir):
    return weekly.week_stats(
        fx.profile(spark, sf_dir), fx.weights(spark, sf_dir), food_rows(spark, sf_dir),
        fx.workout_log(spark, sf_dir), band_daily(spark, sf_dir),
        fx.supplement_log(spark, sf_dir), fx.supplements(spark, sf_dir))


# -------------------------------------------------------------- matching

MENTION_SQL = """(select distinct case l.l_linenumber when 1 then c.choice when 2 then '  ' || upper(c.choice) || ' '
    when 3 then c.choice || 's' when 4 then substr(c.choice, 1, length(c.choice) - 1)
    when 5 then 'homemade ' || c.choice when 6 then p.p_name else c.choice || ' fresh' end as mention
  from lineitem l join part p on l.l_partkey = p.p_partkey join food_choice c on l.l_partkey % 121 = c.ord)"""


def _food_match_sql():
    return oracle.with_ctes(
        oracle.fuzzy_sql(MENTION_SQL, "mention", "food_choice", "choice", "ord", 85, True, payload=("food_id",))
        + """
select b.q as mention, b.matched, b.ord, b.food_id, b.score, case when b.food_id is not null then 'built-in' end as source
from fz_best b""")


@register("food_match", _food_match_sql)
def q_food_match(spark, sf_dir):
    from ..operators import fuzzy
    ch = dims.food_choice_df(spark)
    return fuzzy.match_food(fx.food_mentions(spark, sf_dir, ch), ch)


EX_MENTION_SQL = """(select distinct case l.l_suppkey % 3 when 0 then 'Full gym' when 1 then 'Dumbbells at home' else 'Bodyweight only' end as equipment,
    case l.l_linenumber when 1 then e.name when 2 then lower(e.name) when 3 then e.name || 's'
      when 4 then substr(e.name, 1, length(e.name) - 1)
      when 5 then array_to_string(list_reverse(string_split(e.name, ' ')), ' ')
      when 6 then p.p_name else upper(e.name) end as mention
  from lineitem l join part p on l.l_partkey = p.p_partkey join exercise e on l.l_partkey % 48 = e.exercise_id)"""
ALLOWED_SQL = "(select k.profile as equipment, e.name, e.exercise_id from exercise e join equipment_kind k on e.equipment = k.kind)"


@register("exercise_match", lambda: oracle.with_ctes(
    oracle.fuzzy_sql(EX_MENTION_SQL, "mention", ALLOWED_SQL, "name", "exercise_id", 90, False, keys=("equipment",))
    + "\nselect b.equipment, b.q as mention, b.matched, b.ord, b.score from fz_best b"))
def q_exercise_match(spark, sf_dir):
    from ..operators import fuzzy, workouts
    lib = dims.exercise_df(spark)
    allowed = workouts.allowed_exercises(lib, dims.equipment_kind_df(spark))
    return fuzzy.match_exercise(fx.exercise_mentions(spark, sf_dir, lib), allowed)


MARKER_MENTION_SQL = """(select distinct o.o_custkey as user_id, trim(case l.l_linenumber when 1 then p.p_type when 2 then lower(p.p_type)
    when 3 then p.p_type || 'S' when 4 then substr(p.p_type, 1, length(p.p_type) - 1)
    when 5 then upper(substr(p.p_type, 1, 1)) || lower(substr(p.p_type, 2)) when 6 then p.p_name
    else ' ' || p.p_type || ' ' end) as mention
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey)"""
KNOWN_SQL = """(select user_id, marker, dense_rank() over (partition by user_id order by marker) as ord
  from (select distinct user_id, marker from lab_results))"""


@register("marker_canonicalise", lambda: oracle.with_ctes(
    oracle.fuzzy_sql(MARKER_MENTION_SQL, "mention", KNOWN_SQL, "marker", "ord", 90, False, keys=("user_id",))
    + "\nselect b.user_id, b.q as mention, coalesce(b.matched, b.q) as marker, b.score from fz_best b"))
def q_marker_canonicalise(spark, sf_dir):
    from ..operators import fuzzy
    return fuzzy.canonical_marker(fx.marker_mentions(spark, sf_dir), fx.lab_results(spark, sf_dir))


# ------------------------------------------------------------ meal rows

def _meal_items_sql():
    units = ", ".join("NULL" if u is None else "'" + u + "'" for u in fx.MEAL_UNITS)
    meals = ", ".join("'" + m + "'" for m in dims.MEALS)
    return f"""(select l.l_suppkey as user_id, date '2024-01-01' + cast(l.l_orderkey % 30 as int) as day,
    [{meals}][cast(l.l_orderkey % {len(dims.MEALS)} + 1 as int)] as meal, l.l_orderkey as meal_id, l.l_linenumber as line,
    case l.l_linenumber when 1 then c.choice when 2 then '  ' || upper(c.choice) || ' '
      when 3 then c.choice || 's' when 4 then substr(c.choice, 1, length(c.choice) - 1)
      when 5 then 'homemade ' || c.choice when 6 then p.p_name else c.choice || ' fresh' end as mention,
    l.l_quantity / 2 as quantity, [{units}][cast(l.l_orderkey % {len(fx.MEAL_UNITS)} + 1 as int)] as unit
  from lineitem l join part p on l.l_partkey = p.p_partkey join food_choice c on l.l_partkey % 121 = c.ord)"""


def _resolved_sql():
    """CTE ``resolved``: the stored food rows of the meal items."""
    return oracle.fuzzy_sql(_meal_items_sql(), "mention", "food_choice", "choice", "ord", 85, True,
                            payload=("food_id",)) + f"""
, items as {_meal_items_sql()},
mu as (select i.*, b.food_id, 'built-in' as src,
    lower(trim(coalesce(case when i.unit <> '' then i.unit end, 'serving'))) as u0
  from items i join fz_best b on b.q = i.mention where b.food_id is not null),
mu2 as (select mu.*, coalesce(s.unit, mu.u0) as cu from mu left join unit_synonym s on s.alias = mu.u0),
mg as (select mu2.*, fu.grams as own, sv.grams as serving, coalesce(fb.grams, 100.0) as fallback
  from mu2 left join food_unit fu on fu.food_id = mu2.food_id and fu.unit = mu2.cu
  left join food_unit sv on sv.food_id = mu2.food_id and sv.unit = 'serving'
  left join fallback_grams fb on fb.unit = mu2.cu),
mr as (select mg.*, cast(round_even(case when cu in ('g', 'ml') then cast(quantity as decimal(18,4))
      when cu in ('kg', 'l') then cast(quantity as decimal(18,4)) * 1000
      when own is not null then cast(quantity as decimal(18,4)) * cast(own as decimal(18,4))
      when cu in ('piece', 'plate', 'serving') and serving is not null
      then cast(quantity as decimal(18,4)) * cast(serving as decimal(18,4))
      else cast(quantity as decimal(18,4)) * cast(fallback as decimal(18,4)) end, 1) as double) as grams,
    (cu in ('g', 'ml', 'kg', 'l') or own is not null) as exact from mg),
resolved as (select mr.user_id, mr.day, mr.meal, mr.meal_id, mr.line, d.name as item, mr.quantity, mr.unit, mr.grams,
    case when exact then src else src || ' (check grams)' end as source,
    {oracle.tot('d.kcal', 'mr.grams')} as kcal, {oracle.tot('d.protein', 'mr.grams')} as protein,
    {oracle.tot('d.carbs', 'mr.grams')} as carbs, {oracle.tot('d.fat', 'mr.grams')} as fat
  from mr join food d on d.food_id = mr.food_id)"""


def resolved_rows(spark, sf_dir):
    from ..operators import fuzzy
    ch = dims.food_choice_df(spark)
    items = fx.meal_items(spark, sf_dir, ch)
    return food.resolve_meal_items(items, fuzzy.match_food(items, ch), dims.food_df(spark))


@register("meal_resolve", lambda: oracle.with_ctes(_resolved_sql() + """
select user_id, cast(day as varchar) as day, meal, meal_id, line, item, quantity, unit, grams, source,
  kcal, protein, carbs, fat from resolved"""))
def q_meal_resolve(spark, sf_dir):
    return resolved_rows(spark, sf_dir)


@register("meal_total", lambda: oracle.with_ctes(_resolved_sql() + """
select user_id, cast(day as varchar) as day, meal,
  cast(sum(cast(kcal as decimal(18,1))) as double) as kcal, cast(sum(cast(protein as decimal(18,1))) as double) as protein,
  cast(sum(cast(carbs as decimal(18,1))) as double) as carbs, cast(sum(cast(fat as decimal(18,1))) as double) as fat
from resolved group by user_id, day, meal"""))
def q_meal_total(spark, sf_dir):
    return food.meal_totals(resolved_rows(spark, sf_dir))


@register("food_daily", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, cast(sum(cast(kcal as decimal(18,1))) as double) as kcal,
  cast(sum(cast(protein as decimal(18,1))) as double) as protein from food_rows group by user_id, day"""))
def q_food_daily(spark, sf_dir):
    d = food.daily_totals(food_rows(spark, sf_dir), ("kcal", "protein"))
    return d.select("user_id", "day", F.col("kcal").cast("double").alias("kcal"),
                    F.col("protein").cast("double").alias("protein"))


DAY_SPINE_SQL = "(select user_id, day from weights union select user_id, day from food_rows)"
DAY_MACROS_SQL = f"""
, spine as {DAY_SPINE_SQL},
dm as (select s.user_id, s.day,
  coalesce(cast(sum(cast(f.kcal as decimal(18,1))) as double), 0.0) as kcal,
  coalesce(cast(sum(cast(f.protein as decimal(18,1))) as double), 0.0) as protein,
  coalesce(cast(sum(cast(f.carbs as decimal(18,1))) as double), 0.0) as carbs,
  coalesce(cast(sum(cast(f.fat as decimal(18,1))) as double), 0.0) as fat
  from spine s left join food_rows f on f.user_id = s.user_id and f.day = s.day group by s.user_id, s.day)"""


def _day_macros(spark, sf_dir):
    rows = food_rows(spark, sf_dir)
    spine = fx.weights(spark, sf_dir).select("user_id", "day").unionByName(rows.select("user_id", "day")).distinct()
    return food.day_macros(spine, rows)


@register("day_macros", lambda: oracle.with_ctes(DAY_MACROS_SQL + """
select user_id, cast(day as varchar) as day, kcal, protein, carbs, fat from dm"""))
def q_day_macros(spark, sf_dir):
    return _day_macros(spark, sf_dir)


@register("macro_progress", lambda: oracle.with_ctes(DAY_MACROS_SQL + f"""
, lw as (select user_id, arg_max(kg, day) as kg from weights group by user_id),
tg as (select p.user_id, {oracle.targets_cols('lw.kg')} from profile p join lw on lw.user_id = p.user_id
       left join activity_dim a on a.activity = p.activity)
select dm.user_id, cast(dm.day as varchar) as day,
  dm.kcal as kcal_eaten, tg.kcal - dm.kcal as kcal_remaining,
  case when tg.kcal is null or tg.kcal = 0 then 0.0 else least(dm.kcal / tg.kcal, 1.0) end as kcal_progress,
  dm.protein as protein_eaten, tg.protein - dm.protein as protein_remaining,
  case when tg.protein is null or tg.protein = 0 then 0.0 else least(dm.protein / tg.protein, 1.0) end as protein_progress,
  dm.carbs as carbs_eaten, tg.carbs - dm.carbs as carbs_remaining,
  case when tg.carbs is null or tg.carbs = 0 then 0.0 else least(dm.carbs / tg.carbs, 1.0) end as carbs_progress,
  dm.fat as fat_eaten, tg.fat - dm.fat as fat_remaining,
  case when tg.fat is null or tg.fat = 0 then 0.0 else least(dm.fat / tg.fat, 1.0) end as fat_progress
from dm join tg on tg.user_id = dm.user_id"""))
def q_macro_progress(spark, sf_dir):
    return food.progress(_day_macros(spark, sf_dir), q_targets(spark, sf_dir))


# --------------------------------------------------------------- weights

AS_OF = "2024-01-30"


@register("weight_rolling_7d", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, kg,
  cast(sum(cast(kg as decimal(18,4))) over w as double) / count(kg) over w as avg_7d
from (select *, count(*) over (partition by user_id) as n from weights) x where n >= 2
window w as (partition by user_id order by day range between interval 6 days preceding and current row)"""))
def q_weight_rolling(spark, sf_dir):
    return weights.rolling_7d(fx.weights(spark, sf_dir))


@register("weight_trend", lambda: oracle.with_ctes("""
, e as (select user_id, max(day) as end_day from weights group by user_id),
g as (select w.user_id, e.end_day,
  case when count(case when e.end_day - w.day < 7 then kg end) > 0 then
    cast(sum(case when e.end_day - w.day < 7 then cast(kg as decimal(18,4)) end) as double)
    / count(case when e.end_day - w.day < 7 then kg end) end as recent_mean,
  case when count(case when e.end_day - w.day >= 7 and e.end_day - w.day < 14 then kg end) > 0 then
    cast(sum(case when e.end_day - w.day >= 7 and e.end_day - w.day < 14 then cast(kg as decimal(18,4)) end) as double)
    / count(case when e.end_day - w.day >= 7 and e.end_day - w.day < 14 then kg end) end as prior_mean
  from weights w join e on e.user_id = w.user_id group by w.user_id, e.end_day)
select user_id, cast(end_day as varchar) as end_day, recent_mean, prior_mean, recent_mean - prior_mean as rate_kg_per_week,
  100 * (recent_mean - prior_mean) / prior_mean as pct, 100 * (recent_mean - prior_mean) / prior_mean < -1 as fast_cut
from g where recent_mean is not null and prior_mean is not null"""))
def q_weight_trend(spark, sf_dir):
    return weights.trend(fx.weights(spark, sf_dir))


@register("latest_weight", lambda: oracle.with_ctes(
    "select user_id, cast(max(day) as varchar) as day, arg_max(kg, day) as kg from weights group by user_id"))
def q_latest_weight(spark, sf_dir):
    return weights.latest(fx.weights(spark, sf_dir))


@register("weight_asof_week_end", lambda: oracle.with_ctes("""
, pts as (select distinct user_id, cast(date_trunc('week', day) as date) + 6 as point_day from food_rows
          union select distinct user_id, cast(date_trunc('week', day) as date) + 6 from weights)
select p.user_id, cast(p.point_day as varchar) as point_day,
  (select arg_max(w.kg, w.day) from weights w where w.user_id = p.user_id and w.day <= p.point_day) as asof_kg
from pts p"""))
def q_weight_asof(spark, sf_dir):
    from ..functions.time import week_start
    w = fx.weights(spark, sf_dir)
    pts = (food_rows(spark, sf_dir).select("user_id", "day").unionByName(w.select("user_id", "day"))
           .select("user_id", F.date_add(week_start("day"), 6).alias("point_day")))
    return weights.asof(w, pts, "point_day")


# -------------------------------------------------------------- training

@register("e1rm_trend", lambda: oracle.with_ctes("""
select w.user_id, e.name as exercise, cast(w.day as varchar) as day,
  max(case when w.weight_kg is not null and w.weight_kg <> 0 and w.reps is not null and w.reps <> 0
      then w.weight_kg * (1 + w.reps / 30) else 0.0 end) as e1rm
from workout_log w join exercise e on e.exercise_id = w.exercise_id group by w.user_id, e.name, w.day"""))
def q_e1rm_trend(spark, sf_dir):
    from ..operators import workouts
    return workouts.e1rm_trend(fx.workout_log(spark, sf_dir), dims.exercise_df(spark))


@register("known_exercises", lambda: oracle.with_ctes("""
select distinct w.user_id, e.name as exercise from workout_log w join exercise e on e.exercise_id = w.exercise_id"""))
def q_known_exercises(spark, sf_dir):
    from ..operators import workouts
    return workouts.known_exercises(fx.workout_log(spark, sf_dir), dims.exercise_df(spark))


# ------------------------------------------------------------------ labs

LAB_FLAG_SQL = """case when ref_low is not null and value < ref_low then 'Low'
  when ref_high is not null and value > ref_high then 'High' else 'In range' end"""


@register("lab_flag", lambda: oracle.with_ctes(f"""
select user_id, cast(test_date as varchar) as test_date, marker, value, ref_low, ref_high, line, report_id,
  {LAB_FLAG_SQL} as flag from lab_results"""))
def q_lab_flag(spark, sf_dir):
    from ..operators import labs
    return labs.with_flag(fx.lab_results(spark, sf_dir))


LATEST_SQL = """(select l.* from lab_results l join (select user_id, max(test_date) as md from lab_results group by user_id) m
  on m.user_id = l.user_id and m.md = l.test_date)"""


@register("latest_lab_report", lambda: oracle.with_ctes(f"""
select user_id, cast(test_date as varchar) as test_date, marker, value, ref_low, ref_high, line, report_id,
  {LAB_FLAG_SQL} as flag from {LATEST_SQL}"""))
def q_latest_lab_report(spark, sf_dir):
    from ..operators import labs
    return labs.with_flag(labs.latest_report(fx.lab_results(spark, sf_dir)))


@register("flagged_lines", lambda: oracle.with_ctes(f"""
, f as (select *, {LAB_FLAG_SQL} as flag from {LATEST_SQL}),
g as (select *, marker || ': ' || coalesce(cast(value as varchar), 'None') || ' ' || '' || ' (range '
    || coalesce(cast(ref_low as varchar), 'None') || '-' || coalesce(cast(ref_high as varchar), 'None') || ') -> ' || flag as ln
  from f where flag <> 'In range')
select user_id, cast(test_date as varchar) as test_date, count(*) as n_flagged,
  string_agg(ln, chr(10) order by report_id, line, ln) as flagged from g group by user_id, test_date"""))
def q_flagged_lines(spark, sf_dir):
    from ..operators import labs
    return labs.flagged_lines(labs.latest_report(fx.lab_results(spark, sf_dir)))


@register("lab_trend", lambda: oracle.with_ctes("""
select user_id, marker, cast(test_date as varchar) as test_date, count(*) as n,
  cast(min(value) as double) as min_value, cast(max(value) as double) as max_value,
  string_agg(cast(value as varchar), ',' order by report_id, line, value) as series
from lab_results group by user_id, marker, test_date"""))
def q_lab_trend(spark, sf_dir):
    from ..operators import labs
    return labs.trend(fx.lab_results(spark, sf_dir))


@register("lab_items_normalise", """
with b as (select l_orderkey as report_id, l_linenumber as chunk, (l_orderkey + l_linenumber) % 6 as v, p_type as marker, l_quantity as q
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)
select report_id, chunk, 0 as item_pos, marker, q as value, 'mg/dL' as unit, 1.0::double as ref_low, 30.0::double as ref_high from b where v = 0
union all select report_id, chunk, 0, marker, q, 'mg/dL', null, 30.5 from b where v = 1
union all select report_id, chunk, 1, marker, q, '', null, null from b where v = 2
union all select report_id, chunk, 1, marker, 1.0, '5', null, null from b where v = 3
union all select report_id, chunk, 2, marker, q, '', 2.5, null from b where v = 5""")
def q_lab_items(spark, sf_dir):
    from ..sources import model_json
    return model_json.lab_items(fx.lab_outputs(spark, sf_dir), ["report_id", "chunk"])


@register("lab_json_report_date", """
select l_orderkey as report_id, arg_min(cast(cast(o_orderdate as date) + l_linenumber as varchar), l_linenumber) as test_date
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
where (l_orderkey + l_linenumber) % 6 in (0, 1, 5) group by l_orderkey""")
def q_lab_json_report_date(spark, sf_dir):
    from ..operators import labs
    from ..sources import model_json
    return labs.report_date(model_json.lab_reports(fx.lab_outputs(spark, sf_dir), ["report_id", "chunk"]))


@register("known_markers", lambda: oracle.with_ctes("select distinct user_id, marker from lab_results"))
def q_known_markers(spark, sf_dir):
    return fx.lab_results(spark, sf_dir).select("user_id", "marker").distinct()


@register("text_chunks", """
select doc_id, cast(i as bigint) as chunk, substr(text, cast(i * 6000 + 1 as bigint), 6000) as text
from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 6000) as bigint))) as i from documents)""")
def q_text_chunks(spark, sf_dir):
    from ..operators import labs
    from ..sources.tables import read_table
    c = labs.text_chunks(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


@register("short_text_guard", """
select doc_id, cast(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as int) as stripped_chars,
  length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50 as accepted from documents""")
def q_short_text_guard(spark, sf_dir):
    from ..operators import labs
    from ..sources.tables import read_table
    return labs.short_text_guard(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@register("report_date", """
select report_id, arg_min(test_date, chunk) as test_date from (
  select l_orderkey as report_id, l_linenumber as chunk,
    case when l_linenumber % 3 = 1 then '' else cast(cast(o_orderdate as date) + l_linenumber as varchar) end as test_date
  from lineitem join orders on l_orderkey = o_orderkey) x
where test_date is not null and trim(test_date) <> '' group by report_id""")
def q_report_date(spark, sf_dir):
    from ..operators import labs
    return labs.report_date(fx.chunk_dates(spark, sf_dir))


@register("lab_dedupe_first", lambda: oracle.with_ctes(
    oracle.fuzzy_sql(MARKER_MENTION_SQL, "mention", KNOWN_SQL, "marker", "ord", 90, False, keys=("user_id",))
    + """
, ext as (select o.o_custkey as user_id, l.l_orderkey as report_id, (l.l_linenumber - 1) // 4 as chunk, l.l_linenumber as pos,
    trim(case l.l_linenumber when 1 then p.p_type when 2 then lower(p.p_type)
    when 3 then p.p_type || 'S' when 4 then substr(p.p_type, 1, length(p.p_type) - 1)
    when 5 then upper(substr(p.p_type, 1, 1)) || lower(substr(p.p_type, 2)) when 6 then p.p_name
    else ' ' || p.p_type || ' ' end) as mention, l.l_quantity as value
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey),
c as (select e.report_id, coalesce(b.matched, e.mention) as marker, e.chunk, e.pos, e.value
  from ext e join fz_best b on b.user_id = e.user_id and b.q = e.mention),
r as (select *, row_number() over (partition by report_id, marker order by chunk, pos, value) as rn from c)
select report_id, marker, chunk, pos, value from r where rn = 1"""))
def q_lab_dedupe_first(spark, sf_dir):
    from ..operators import fuzzy, labs
    ext = fx.lab_extract_rows(spark, sf_dir)
    canon = fuzzy.canonical_marker(ext.select("user_id", "mention"), fx.lab_results(spark, sf_dir))
    rows = (ext.withColumn("mention", F.trim("mention"))
               .join(canon.select("user_id", "mention", "marker"), ["user_id", "mention"])
               .select("report_id", "marker", "chunk", "pos", "value"))
    return labs.dedupe_first(rows)


# ----------------------------------------------------------- supplements

@register("supplement_log_join", lambda: oracle.with_ctes("""
select l.user_id, cast(l.day as varchar) as day, l.supplement_id, s.name, l.taken
from supplement_log l join supplements s on s.user_id = l.user_id and s.supplement_id = l.supplement_id"""))
def q_supplement_log_join(spark, sf_dir):
    from ..operators import supplements as sup
    return sup.log_join(fx.supplement_log(spark, sf_dir), fx.supplements(spark, sf_dir))


@register("supplement_checklist", lambda: oracle.with_ctes("""
, sp as (select distinct user_id, day from supplement_log),
a as (select * from supplements where active = 1)
select sp.user_id, cast(sp.day as varchar) as day, a.supplement_id, a.timing, a.name,
  trim(coalesce(a.name, '') || ' · ' || coalesce(a.dose, '') || ' · ' || coalesce(a.timing, ''), ' ·') as label,
  coalesce(l.taken, 0) as taken
from sp join a on a.user_id = sp.user_id
left join supplement_log l on l.user_id = sp.user_id and l.day = sp.day and l.supplement_id = a.supplement_id"""))
def q_supplement_checklist(spark, sf_dir):
    from ..operators import supplements as sup
    log = fx.supplement_log(spark, sf_dir)
    return sup.checklist(log.select("user_id", "day").distinct(), log, fx.supplements(spark, sf_dir))


@register("adherence_14d", lambda: oracle.with_ctes(f"""
select l.user_id, s.name, cast(sum(l.taken) as bigint) as taken
from supplement_log l join supplements s on s.user_id = l.user_id and s.supplement_id = l.supplement_id
where l.day >= date '{AS_OF}' - 14 group by l.user_id, s.name"""))
def q_adherence_14d(spark, sf_dir):
    from ..operators import supplements as sup
    return sup.adherence_recent(fx.supplement_log(spark, sf_dir), fx.supplements(spark, sf_dir), AS_OF, 14)


@register("active_supplements", lambda: oracle.with_ctes(
    "select user_id, supplement_id, name, dose, timing from supplements where active = 1"))
def q_active_supplements(spark, sf_dir):
    from ..operators import supplements as sup
    return sup.active(fx.supplements(spark, sf_dir)).select("user_id", "supplement_id", "name", "dose", "timing")


@register("week_supplement_adherence", lambda: oracle.with_ctes("""
, n as (select user_id, count(*) filter (where active = 1) as n from supplements group by user_id)
select l.user_id, cast(cast(date_trunc('week', day) as date) as varchar) as week_start, cast(sum(taken) as bigint) as taken,
  case when max(n.n) > 0 then cast(round_even(100 * sum(taken) / (7 * max(n.n)), 0) as bigint) end as supplement_adherence_pct
from supplement_log l left join n on n.user_id = l.user_id group by l.user_id, cast(date_trunc('week', day) as date)"""))
def q_week_supplement_adherence(spark, sf_dir):
    from ..operators import supplements as sup
    return sup.week_adherence(fx.supplement_log(spark, sf_dir), fx.supplements(spark, sf_dir))


@register("band_last_30d", lambda: oracle.with_ctes(f"""
select user_id, cast(day as varchar) as day, sleep_hours, sleep_score, resting_hr, steps, stress
from band_daily where day >= date '{AS_OF}' - 30"""))
def q_band_last_30d(spark, sf_dir):
    return band.last_days(band_daily(spark, sf_dir), AS_OF, 30)


# ----------------------------------------------------------- model output

def _meal_json_base_sql():
    units = ", ".join("'" + u + "'" for u in dims.UNITS)
    return f"""(select l.l_suppkey as user_id, l.l_orderkey as meal_id, l.l_linenumber as line, l.l_orderkey % 6 as v,
    case l.l_linenumber when 1 then c.choice when 2 then '  ' || upper(c.choice) || ' '
      when 3 then c.choice || 's' when 4 then substr(c.choice, 1, length(c.choice) - 1)
      when 5 then 'homemade ' || c.choice when 6 then p.p_name else c.choice || ' fresh' end as name,
    l.l_quantity / 2 as q, [{units}][cast(l.l_orderkey % {len(dims.UNITS)} + 1 as int)] as u
  from lineitem l join part p on l.l_partkey = p.p_partkey join food_choice c on l.l_partkey % 121 = c.ord)"""


@register("model_json_repair", lambda: oracle.with_ctes(f"""
select user_id, meal_id, line, case when v = 1 then 'repaired' when v = 5 and line % 2 = 1 then 'rejected'
  else 'parsed' end as status from {_meal_json_base_sql()}"""))
def q_model_json_repair(spark, sf_dir):
    from ..sources import model_json
    o = fx.meal_outputs(spark, sf_dir, dims.food_choice_df(spark))
    return o.select("user_id", "meal_id", "line", model_json.parse_status("text").alias("status"))


@register("meal_items_normalise", lambda: oracle.with_ctes(f"""
, b as {_meal_json_base_sql()}
select user_id, meal_id, line, cast(case when v = 4 then 1 else 0 end as int) as item_pos, trim(name) as name,
  case when v in (0, 1, 2, 3) then q else 1.0 end as quantity,
  case when v in (0, 1, 3) then u when v = 5 then '5' else 'serving' end as unit
from b where not (v = 3 and line = 3) and not (v = 5 and line % 2 = 1)"""))
def q_meal_items_normalise(spark, sf_dir):
    from ..sources import model_json
    o = fx.meal_outputs(spark, sf_dir, dims.food_choice_df(spark))
    return model_json.meal_items(o, ["user_id", "meal_id", "line"])


ESTIMATE_BASE_SQL = """(select p_partkey, p_name as name, p_partkey % 5 as v,
    cast(case when p_partkey % 5 = 2 then 0 when p_partkey % 5 = 4 then p_size * 30 else p_size * 10 end as double) as k,
    cast(case when p_partkey % 5 = 3 then 0 else p_size % 30 end as double) as pr,
    cast(p_size % 45 as double) as cb,
    cast(case when p_partkey % 5 = 1 then 0 else p_size % 20 end as double) as ft, p_size
  from part)"""


@register("food_estimate_clean", lambda: oracle.with_ctes(f"""
, b as {ESTIMATE_BASE_SQL},
a as (select *, pr * 4 + cb * 4 + ft * 9 as atw from b)
select p_partkey, name, case when atw <> 0 and abs(k - atw) / atw > 0.25 then atw else k end as kcal,
  pr as protein, cb as carbs, ft as fat,
  cast(case v when 0 then (case when p_size > 0 and p_size < 2000 then 1 else 0 end) + 1 when 1 then 1
       when 4 then (case when p_size * 7.5 > 0 and p_size * 7.5 < 2000 then 1 else 0 end) else 0 end as int) as n_units
from a"""))
def q_food_estimate_clean(spark, sf_dir):
    from ..sources import model_json
    e = model_json.food_estimates(fx.estimate_outputs(spark, sf_dir), ["p_partkey", "name"])
    return e.select("p_partkey", "name", "kcal", "protein", "carbs", "fat", F.size("units").alias("n_units"))


@register("food_estimate_units", """
select p_partkey, unit, grams from (
  select p_partkey, 'piece' as unit, cast(p_size as double) as grams from part where p_partkey % 5 = 0
  union all select p_partkey, 'serving', 100.0 from part where p_partkey % 5 = 0
  union all select p_partkey, 'cup', 240.0 from part where p_partkey % 5 = 1
  union all select p_partkey, 'bowl', p_size * 7.5 from part where p_partkey % 5 = 4) x
where grams > 0 and grams < 2000""")
def q_food_estimate_units(spark, sf_dir):
    from ..sources import model_json
    e = model_json.food_estimates(fx.estimate_outputs(spark, sf_dir), ["p_partkey"])
    return e.select("p_partkey", F.explode("units").alias("unit", "grams"))


# ------------------------------------------------------------ band files

@register("band_csv_parse", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, max(sleep_hours) as sleep_hours, max(sleep_score) as sleep_score,
  max(resting_hr) as resting_hr, max(steps) as steps, max(stress) as stress from (
  select user_id, day, sleep_hours, sleep_score, null::double as resting_hr, null::bigint as steps, null::double as stress
  from sleep_daily where user_id % 4 <> 3
  union all select user_id, day, null, null, resting_hr, null, null from heart_daily
  union all select user_id, day, null, null, null, steps, null from steps_daily
  union all select user_id, day, null, null, null, null, stress from stress_daily) u group by user_id, day"""))
def q_band_csv_parse(spark, sf_dir):
    from ..sources import band_csv
    return band_csv.daily_from_lines(export_lines(spark, sf_dir))


def export_lines(spark, sf_dir):
    """The export-file lines of the tables in ``sf_dir``, made anew each time."""
    return fx.band_export_lines(spark, sf_dir)


@register("import_summary", lambda: oracle.with_ctes("""
, d as (select user_id, day from sleep_daily where user_id % 4 <> 3 union select user_id, day from heart_daily
  union select user_id, day from steps_daily union select user_id, day from stress_daily),
f as (select user_id, count(*) as files_used from (
  select distinct user_id, 's' as k from sleep_daily where user_id % 4 <> 3
  union all select distinct user_id, 'h' from heart_daily
  union all select distinct user_id, 'p' || reading_id % 2 from band_reading where metric = 'steps'
  union all select distinct user_id, 't' from stress_daily) x group by user_id)
select coalesce(a.user_id, f.user_id) as user_id, a.days_saved, f.files_used
from (select user_id, count(*) as days_saved from d group by user_id) a full outer join f on f.user_id = a.user_id"""))
def q_import_summary(spark, sf_dir):
    from ..sources import band_csv
    return band_csv.import_summary(export_lines(spark, sf_dir))


# ------------------------------------------------------------- snapshots

def _weights_old_new(spark, sf_dir):
    w = fx.weights(spark, sf_dir)
    old = w.where(F.dayofmonth("day") % 3 != 0)
    new = w.where(F.dayofmonth("day") % 2 == 0).withColumn("kg", F.col("kg") + 0.5)
    return w, old, new


@register("upsert_replace", lambda: oracle.with_ctes("""
, o as (select * from weights where day(day) % 3 <> 0),
n as (select user_id, day, case when day(day) % 4 = 0 then kg + 1.5 else kg + 0.5 end as kg from weights where day(day) % 2 = 0)
select user_id, cast(day as varchar) as day, kg from n
union all select user_id, cast(day as varchar), kg from o
  where not exists (select 1 from n where n.user_id = o.user_id and n.day = o.day)"""))
def q_upsert_replace(spark, sf_dir):
    from ..operators import snapshot
    _w, old, new = _weights_old_new(spark, sf_dir)
    new = new.withColumn("seq", F.lit(1))
    again = new.where(F.dayofmonth("day") % 4 == 0).withColumn("kg", F.col("kg") + 1).withColumn("seq", F.lit(2))
    return snapshot.upsert_replace(old, again.unionByName(new), ["user_id", "day"], seq="seq")


@register("band_upsert_coalesce", lambda: oracle.with_ctes("""
, o as (select * from band_daily where day(day) % 2 = 0),
n as (select user_id, day, null::double as sleep_hours, null::double as sleep_score, resting_hr + 1 as resting_hr,
        steps, stress from band_daily where day(day) % 3 = 0)
select coalesce(n.user_id, o.user_id) as user_id, cast(coalesce(n.day, o.day) as varchar) as day,
  coalesce(n.sleep_hours, o.sleep_hours) as sleep_hours, coalesce(n.sleep_score, o.sleep_score) as sleep_score,
  coalesce(n.resting_hr, o.resting_hr) as resting_hr, coalesce(n.steps, o.steps) as steps,
  coalesce(n.stress, o.stress) as stress
from o full outer join n on n.user_id = o.user_id and n.day = o.day"""))
def q_band_upsert_coalesce(spark, sf_dir):
    d = band_daily(spark, sf_dir)
    old = d.where(F.dayofmonth("day") % 2 == 0)
    new = (d.where(F.dayofmonth("day") % 3 == 0)
            .withColumn("sleep_hours", F.lit(None).cast("double")).withColumn("sleep_score", F.lit(None).cast("double"))
            .withColumn("resting_hr", F.col("resting_hr") + 1))
    return band.upsert_coalesce(old, new)


@register("delete_rows", lambda: oracle.with_ctes(
    "select user_id, cast(day as varchar) as day, kg from weights where day(day) % 5 <> 0"))
def q_delete_rows(spark, sf_dir):
    from ..operators import snapshot
    w = fx.weights(spark, sf_dir)
    return snapshot.delete_keys(w, w.where(F.dayofmonth("day") % 5 == 0), ["user_id", "day"])


@register("update_rows", lambda: oracle.with_ctes("""
select s.user_id, s.supplement_id, s.name,
  case when s.supplement_id % 3 = 0 then 'x' || s.dose else s.dose end as dose,
  case when s.supplement_id % 3 = 0 then 'Morning' else s.timing end as timing,
  case when s.supplement_id % 3 = 0 then 1 - s.active else s.active end as active
from supplements s"""))
def q_update_rows(spark, sf_dir):
    from ..operators import snapshot
    s = fx.supplements(spark, sf_dir)
    patch = (s.where(F.col("supplement_id") % 3 == 0)
              .select("user_id", "supplement_id", F.concat(F.lit("x"), F.col("dose")).alias("dose"),
                      F.lit("Morning").alias("timing"), (1 - F.col("active")).alias("active")))
    return snapshot.update_by_key(s, patch, ["user_id", "supplement_id"], ["dose", "timing", "active"])


@register("append_rows", lambda: oracle.with_ctes(
    "select user_id, cast(day as varchar) as day, food_id, grams, line, item, kcal, protein, carbs, fat from food_rows"))
def q_append_rows(spark, sf_dir):
    from ..operators import snapshot
    rows = food_rows(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("date")
    return snapshot.append(rows.where(F.col("day") < cut), rows.where(F.col("day") >= cut)).select(
        "user_id", "day", "food_id", "grams", "line", "item", "kcal", "protein", "carbs", "fat")


# --------------------------------------------------------------- quality

@register("validate_profile", lambda: oracle.with_ctes("""
select user_id, v as violations from (
  select user_id, concat_ws(',',
    case when not coalesce(age between 14 and 90, false) then 'age_14_90' end,
    case when not coalesce(height_cm between 120 and 230, false) then 'height_120_230' end,
    case when not coalesce(sex in ('Male', 'Female'), false) then 'sex_known' end,
    case when not coalesce(activity in ('Sedentary', 'Light (1-3 workouts/week)', 'Moderate (3-5 workouts/week)',
      'Very active (6-7 workouts/week)', 'Athlete (2x/day or physical job)'), false) then 'activity_known' end,
    case when not coalesce(deficit_pct between 0 and 30, false) then 'deficit_0_30' end,
    case when not coalesce(protein_g_per_kg between 1.2 and 2.6, false) then 'protein_1.2_2.6' end) as v
  from profile) x where v <> ''"""))
def q_validate_profile(spark, sf_dir):
    from ..operators import quality
    _good, bad = quality.split(fx.profile(spark, sf_dir), quality.PROFILE_RULES)
    return bad.select("user_id", "violations")


@register("validate_workouts", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, exercise_id, sets, reps, weight_kg, v as violations from (
  select *, concat_ws(',',
    case when not coalesce(sets between 1 and 10, false) then 'sets_1_10' end,
    case when not coalesce(reps between 1 and 50, false) then 'reps_1_50' end,
    case when not coalesce(weight_kg between 0 and 400, false) then 'kg_0_400' end,
    case when not coalesce(rpe between 5 and 10, false) then 'rpe_5_10' end) as v
  from workout_log) x where v <> ''"""))
def q_validate_workouts(spark, sf_dir):
    from ..operators import quality
    _good, bad = quality.split(fx.workout_log(spark, sf_dir), quality.WORKOUT_RULES)
    return bad.select("user_id", "day", "exercise_id", "sets", "reps", "weight_kg", "violations")


@register("validate_logs", lambda: oracle.with_ctes(f"""
, m as (select ['{"', '".join(dims.MEALS)}'][cast(l_orderkey % {len(dims.MEALS)} + 1 as int)] as meal, l_suppkey as user_id from lineitem)
select table_name, user_id, violations, count(*) as n from (
  select 'weights' as table_name, user_id, 'kg_35_250' as violations from weights where not coalesce(kg between 35 and 250, false)
  union all select 'supplements', user_id, 'timing_known' from supplements
    where not coalesce(timing in ('{"', '".join(dims.TIMINGS)}'), false)
  union all select 'food_log', user_id, 'meal_known' from m where not coalesce(meal in ('{"', '".join(dims.MEALS)}'), false)) x
group by all"""))
def q_validate_logs(spark, sf_dir):
    """Rows of the other logs that break an entry rule, counted per user."""
    from ..operators import quality
    from ..sources.tables import read_table
    meals = F.array(*[F.lit(m) for m in dims.MEALS])
    food_log = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"]).select(
        F.col("l_suppkey").alias("user_id"),
        F.element_at(meals, (F.col("l_orderkey") % len(dims.MEALS) + 1).cast("int")).alias("meal"))
    out = None
    for name, df, rules in (("weights", fx.weights(spark, sf_dir), quality.WEIGHT_RULES),
                            ("supplements", fx.supplements(spark, sf_dir), quality.SUPPLEMENT_RULES),
                            ("food_log", food_log, quality.MEAL_RULES)):
        bad = quality.split(df, rules)[1].groupBy("user_id", "violations").agg(F.count("*").alias("n"))
        bad = bad.select(F.lit(name).alias("table_name"), "user_id", "violations", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


@register("key_violations", lambda: oracle.with_ctes("""
select 'weights' as table_name, (select count(*) from (select user_id, day from weights group by all having count(*) > 1)) as duplicate_keys
union all select 'supplement_log', (select count(*) from (select user_id, day, supplement_id from supplement_log group by all having count(*) > 1))
union all select 'band_daily', (select count(*) from (select user_id, day from band_daily group by all having count(*) > 1))
union all select 'profile', (select count(*) from (select user_id from profile group by all having count(*) > 1))
union all select 'food_log_line', (select count(*) from (select user_id, day, line, food_id, grams from food_log group by all having count(*) > 1))"""))
def q_key_violations(spark, sf_dir):
    from ..operators import quality
    checks = [("weights", fx.weights(spark, sf_dir), ["user_id", "day"]),
              ("supplement_log", fx.supplement_log(spark, sf_dir), ["user_id", "day", "supplement_id"]),
              ("band_daily", band_daily(spark, sf_dir), ["user_id", "day"]),
              ("profile", fx.profile(spark, sf_dir), ["user_id"]),
              ("food_log_line", fx.food_log(spark, sf_dir), ["user_id", "day", "line", "food_id", "grams"])]
    out = None
    for name, df, key in checks:
        c = quality.duplicate_keys(df, key).agg(F.count("*").alias("duplicate_keys")).select(
            F.lit(name).alias("table_name"), "duplicate_keys")
        out = c if out is None else out.unionByName(c)
    return out


# ----------------------------------------------------------------- plans

def _plan_base_sql():
    wd = ", ".join("'" + d + "'" for d in dims.WEEKDAYS)
    return f"""(select l.l_suppkey as user_id, l.l_orderkey * 8 + l.l_linenumber as plan_id, l.l_linenumber as ln,
    l.l_orderkey % 5 as v, p.p_type as focus,
    case l.l_suppkey % 3 when 0 then 'Full gym' when 1 then 'Dumbbells at home' else 'Bodyweight only' end as equipment,
    case l.l_linenumber when 1 then e.name when 2 then lower(e.name) when 3 then e.name || 's'
      when 4 then substr(e.name, 1, length(e.name) - 1)
      when 5 then array_to_string(list_reverse(string_split(e.name, ' ')), ' ')
      when 6 then p.p_name else upper(e.name) end as mention,
    case when l.l_orderkey % 5 = 3 then 'Sun'
      else [{wd}][isodow(date '2024-01-01' + cast(l.l_orderkey % 30 as int))] end as label
  from lineitem l join part p on l.l_partkey = p.p_partkey join exercise e on l.l_partkey % 48 = e.exercise_id)"""


def _plan_rows_sql():
    wd = ", ".join("'" + d + "'" for d in dims.WEEKDAYS)
    req = ", ".join("'" + d + "'" for d in fx.REQUESTED_DAYS)
    return oracle.fuzzy_sql(EX_MENTION_SQL, "mention", ALLOWED_SQL, "name", "exercise_id", 90, False,
                            keys=("equipment",)) + f"""
, pb as {_plan_base_sql()},
plan_rows as (
  select pb.user_id, pb.plan_id, 0 as day_pos, list_position([{wd}], pb.label) - 1 as weekday_idx, pb.label as day,
    pb.focus, 0 as ex_pos, b.matched as name,
    cast(case pb.v when 0 then least(greatest(pb.ln + 2, 1), 6) when 1 then 4 when 4 then 6 else 3 end as int) as sets,
    case pb.v when 1 then '10' else '8-10' end as reps,
    cast(case pb.v when 0 then 120 when 3 then 60 else 90 end as int) as rest_sec,
    case pb.v when 0 then 'go' when 2 then 'None' else '' end as notes
  from pb join fz_best b on b.equipment = pb.equipment and b.q = pb.mention
  where b.matched is not null and pb.label in ({req}))"""


def plan_rows(spark, sf_dir):
    from ..operators import workouts
    from ..sources import model_json
    lib = dims.exercise_df(spark)
    out = fx.plan_outputs(spark, sf_dir, lib)
    raw = model_json.plan_days(out, ["user_id", "plan_id", "equipment"], fx.REQUESTED_DAYS)
    allowed = workouts.allowed_exercises(lib, dims.equipment_kind_df(spark))
    return workouts.normalise_plan(raw, allowed, ["user_id", "plan_id"])


@register("plan_normalise", lambda: oracle.with_ctes(_plan_rows_sql() + """
select user_id, plan_id, day_pos, weekday_idx, day, focus, ex_pos, name, sets, reps, rest_sec, notes from plan_rows"""))
def q_plan_normalise(spark, sf_dir):
    return plan_rows(spark, sf_dir)


CURRENT_PLAN_SQL = """
, cp as (select r.* from plan_rows r join (select user_id, max(plan_id) as plan_id from plan_rows group by user_id) m
  on m.user_id = r.user_id and m.plan_id = r.plan_id),
wd as (select distinct user_id, day, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(day)] as label from workout_log)"""


@register("plan_for_day", lambda: oracle.with_ctes(_plan_rows_sql() + CURRENT_PLAN_SQL + """
, ent as (select user_id, day_pos, day as label, focus, count(*) as n_exercises from cp group by all),
fe as (select user_id, label, arg_min(focus, day_pos) as focus, arg_min(n_exercises, day_pos) as n_exercises
  from ent group by user_id, label)
select wd.user_id, cast(wd.day as varchar) as day, wd.label, fe.focus, fe.n_exercises
from wd join fe on fe.user_id = wd.user_id and fe.label = wd.label"""))
def q_plan_for_day(spark, sf_dir):
    from ..operators import workouts
    days = fx.workout_log(spark, sf_dir).select("user_id", "day").distinct()
    return workouts.plan_for_day(days, workouts.current_plan(plan_rows(spark, sf_dir)))


WEEK_PLAN_SQL = """(select o.o_custkey as user_id, l.l_orderkey as plan_id, l.l_linenumber as ln, p.p_type as focus,
    case o.o_custkey % 3 when 0 then 'Full gym' when 1 then 'Dumbbells at home' else 'Bodyweight only' end as equipment,
    case l.l_linenumber % 3 when 0 then upper(e.name) when 1 then e.name || 's' else e.name end as mention,
    ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][cast((l.l_orderkey + 3 * l.l_linenumber) % 7 + 1 as int)] as label,
    row_number() over (partition by l.l_orderkey order by l.l_linenumber, p.p_type || '"'
      || case l.l_linenumber % 3 when 0 then upper(e.name) when 1 then e.name || 's' else e.name end || '"') - 1 as day_pos
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
  join exercise e on l.l_partkey % 48 = e.exercise_id)"""


def _week_plan_sql():
    return oracle.fuzzy_sql(f"(select distinct equipment, mention from {WEEK_PLAN_SQL})", "mention", ALLOWED_SQL, "name",
                            "exercise_id", 90, False, keys=("equipment",)) + f"""
, wp as (select x.*, b.matched as name from {WEEK_PLAN_SQL} x join fz_best b on b.equipment = x.equipment and b.q = x.mention
  where b.matched is not null)"""


def week_plan_rows(spark, sf_dir):
    from ..operators import workouts
    from ..sources import model_json
    lib = dims.exercise_df(spark)
    raw = model_json.plan_days(fx.week_plan_outputs(spark, sf_dir, lib), ["user_id", "plan_id", "equipment"], dims.WEEKDAYS)
    allowed = workouts.allowed_exercises(lib, dims.equipment_kind_df(spark))
    return workouts.normalise_plan(raw, allowed, ["user_id", "plan_id"])


@register("plan_week_order", lambda: oracle.with_ctes(_week_plan_sql() + """
select user_id, plan_id, string_agg(label || ': ' || name || ' x' || cast(least(ln, 6) as varchar), '; '
  order by list_position(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], label), day_pos) as week from wp group by user_id, plan_id"""))
def q_plan_week_order(spark, sf_dir):
    """Plans of several days through stored JSON: days Mon..Sun, entries of one
    weekday in the order of the plan."""
    from ..operators import workouts
    back = workouts.plan_from_json(workouts.plan_to_json(week_plan_rows(spark, sf_dir)))
    line = F.concat("day", F.lit(": "), "name", F.lit(" x"), F.col("sets").cast("string"))
    return back.withColumn("_l", line).groupBy("user_id", "plan_id").agg(
        F.expr("listagg(_l, '; ') within group (order by day_pos, ex_pos, _l)").alias("week"))


@register("plan_day_exercises", lambda: oracle.with_ctes(_week_plan_sql() + """
, cur as (select wp.* from wp join (select user_id, max(plan_id) as plan_id from wp group by user_id) m
  on m.user_id = wp.user_id and m.plan_id = wp.plan_id),
fe as (select user_id, label, min(day_pos) as day_pos from cur group by user_id, label),
d as (select distinct o_custkey as user_id, cast(o_orderdate as date) as day from orders)
select d.user_id, cast(d.day as varchar) as day, c.label, c.focus, 0 as ex_pos, c.name, cast(least(c.ln, 6) as int) as sets,
  '8-10' as reps, 90 as rest_sec, '' as notes
from d join cur c on c.user_id = d.user_id and c.label = ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(d.day)]
join fe on fe.user_id = c.user_id and fe.label = c.label and fe.day_pos = c.day_pos"""))
def q_plan_day_exercises(spark, sf_dir):
    from ..operators import workouts
    from ..sources.tables import read_table
    days = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"]).select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    return workouts.plan_exercises_for_day(days, workouts.current_plan(week_plan_rows(spark, sf_dir)))


@register("workout_day_log", lambda: oracle.with_ctes(f"""
select w.user_id, cast(w.day as varchar) as day,
  row_number() over (partition by w.user_id order by w.entry, e.name, w.sets, w.reps, w.weight_kg, w.rpe) as pos,
  e.name as exercise, w.sets, w.reps, w.weight_kg, w.rpe
from workout_log w join exercise e on e.exercise_id = w.exercise_id where w.day = date '{AS_OF}'"""))
def q_workout_day_log(spark, sf_dir):
    from ..operators import workouts
    return workouts.day_sets(fx.workout_log(spark, sf_dir), dims.exercise_df(spark), AS_OF)


@register("supplement_stack", lambda: oracle.with_ctes("""
select user_id, string_agg(name || ', ' || dose || ', ' || timing, chr(10) order by supplement_id) as stack
from supplements where active = 1 group by user_id"""))
def q_supplement_stack(spark, sf_dir):
    from ..operators import supplements as sup
    return sup.stack_text(fx.supplements(spark, sf_dir))


def _exercise_options_sql():
    lib = ", ".join("'" + n + "'" for n, _m, _e in dims.LIBRARY)
    return oracle.with_ctes(_plan_rows_sql() + CURRENT_PLAN_SQL + f"""
, fe as (select user_id, day as label, min(day_pos) as day_pos from cp group by all),
pl as (select cp.user_id, cp.day as label, list(cp.name order by cp.ex_pos) as planned
  from cp join fe on fe.user_id = cp.user_id and fe.label = cp.day and fe.day_pos = cp.day_pos group by all),
o as (select wd.user_id, wd.day, list_concat(coalesce(pl.planned, []::varchar[]),
    list_filter([{lib}], lambda n: not list_contains(coalesce(pl.planned, []::varchar[]), n))) as opts
  from wd left join pl on pl.user_id = wd.user_id and pl.label = wd.label)
select user_id, cast(day as varchar) as day, cast(unnest(range(len(opts))) as int) as pos, unnest(opts) as name from o""")


@register("exercise_options", _exercise_options_sql)
def q_exercise_options(spark, sf_dir):
    from ..operators import workouts
    days = fx.workout_log(spark, sf_dir).select("user_id", "day").distinct()
    return workouts.exercise_options(days, workouts.current_plan(plan_rows(spark, sf_dir)))


# ------------------------------------------------------------ check-in

def _payload_sql():
    fields = [c for c in weekly.WEEK_STATS_COLUMNS if c not in ("user_id", "week_start")]
    obj = ", ".join(f"'{c}', ws.{c}" for c in fields)
    return oracle.week_stats_sql().replace("\nselect wk.user_id, cast(wk.week_start as varchar) as week_start,",
                                           "\n, ws as (select wk.user_id, cast(wk.week_start as varchar) as week_start,", 1) \
        + f")\nselect ws.user_id, ws.week_start, cast(json_object({obj}) as varchar) as payload from ws"


@register("stats_payload", _payload_sql)
def q_stats_payload(spark, sf_dir):
    return weekly.stats_payload(q_week_stats(spark, sf_dir).withColumn("week_start", F.col("week_start").cast("string")))


@register("recent_notes", lambda: _payload_sql().replace(
    "\nselect ws.user_id, ws.week_start, cast(json_object(",
    "\n, nt as (select ws.user_id, ws.week_start, cast(json_object(", 1) + """)
select user_id, week_start, payload as note from (
  select *, row_number() over (partition by user_id order by week_start desc) as rn from nt) x where rn <= 6""")
def q_recent_notes(spark, sf_dir):
    """The six newest weekly notes per user (notes hold the week's stats
    payload; writing prose is not part of this engine)."""
    from pyspark.sql import Window
    notes = q_stats_payload(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy(F.col("week_start").desc())
    return (notes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 6)
                 .select("user_id", "week_start", F.col("payload").alias("note")))


# --------------------------------------------------- custom foods, estimates

ESTIMATE_VALUES_SQL = f"""(select p_partkey, name, case when atw <> 0 and abs(k - atw) / atw > 0.25 then atw else k end as kcal,
    pr as protein, cb as carbs, ft as fat from (select *, pr * 4 + cb * 4 + ft * 9 as atw from {ESTIMATE_BASE_SQL}))"""
ESTIMATE_UNITS_SQL = """(select p_partkey, unit, grams from (
  select p_partkey, 'piece' as unit, cast(p_size as double) as grams from part where p_partkey % 5 = 0
  union all select p_partkey, 'serving', 100.0 from part where p_partkey % 5 = 0
  union all select p_partkey, 'cup', 240.0 from part where p_partkey % 5 = 1
  union all select p_partkey, 'bowl', p_size * 7.5 from part where p_partkey % 5 = 4) x
where grams > 0 and grams < 2000)"""
CUSTOM_SQL = f"""
, eb as {ESTIMATE_VALUES_SQL},
eu as {ESTIMATE_UNITS_SQL},
cf0 as (select eb.p_partkey % (select count(*) from supplier) + 1 as user_id,
    case when eb.p_partkey % 10 = 0 then c.choice else lower(eb.name) end as name,
    eb.p_partkey, eb.kcal, eb.protein, eb.carbs, eb.fat
  from eb left join food_choice c on c.ord = (eb.p_partkey * 7) % 121),
cf as (select user_id, name, p_partkey as cpos, kcal, protein, carbs, fat from (
  select *, row_number() over (partition by user_id, name order by p_partkey desc) as rn from cf0) x where rn = 1)"""


@register("food_dictionary", lambda: oracle.with_ctes(CUSTOM_SQL + """
select cf.user_id, cf.name, cf.kcal, cf.protein, cf.carbs, cf.fat,
  case when f.name is not null then 'built-in' else 'custom' end as source
from cf left join food f on f.name = cf.name"""))
def q_food_dictionary(spark, sf_dir):
    return food.food_dictionary(fx.custom_foods(spark, sf_dir), dims.food_df(spark))


def resolve_custom_ctes():
    items = _meal_items_sql()
    n = len(dims.food_choices())
    return oracle.with_ctes(
        CUSTOM_SQL
        + oracle.fuzzy_sql(items, "mention", "food_choice", "choice", "ord", 85, True, payload=("food_id",),
                           prefix="fzb")
        + f"""
, newc as (select user_id, name, {n} + dense_rank() over (partition by user_id order by cpos) - 1 as ord
  from cf where name not in (select choice from food_choice))"""
        + oracle.fuzzy_sql(f"(select distinct user_id, mention from {items})", "mention", "newc", "name", "ord", 85,
                           True, keys=("user_id",), prefix="fzc")
        + f"""
, items as {items},
ek as (select lower(name) as name_key, min(p_partkey) as p_partkey from eb group by lower(name)),
r0 as (select i.*, b.matched as b_choice, b.score as b_score, fd.name as b_key, c.matched as c_name, c.score as c_score,
    own.cpos as own_pk
  from items i left join fzb_best b on b.q = i.mention left join food fd on fd.food_id = b.food_id
  left join fzc_best c on c.user_id = i.user_id and c.q = i.mention
  left join cf own on own.user_id = i.user_id and own.name = b.matched),
r1 as (select *, case when c_score is not null and (b_score is null or c_score > b_score) then c_name
    when b_score is not null and own_pk is not null then b_choice when b_score is not null then b_key end as item_key from r0),
r2 as (select r1.*, cu.cpos as cu_pk, cu.kcal as cu_kcal, cu.protein as cu_protein, cu.carbs as cu_carbs, cu.fat as cu_fat,
    bf.food_id as bf_id, bf.kcal as bf_kcal, bf.protein as bf_protein, bf.carbs as bf_carbs, bf.fat as bf_fat,
    es.p_partkey as es_pk, es.kcal as es_kcal, es.protein as es_protein, es.carbs as es_carbs, es.fat as es_fat
  from r1 left join cf cu on cu.user_id = r1.user_id and cu.name = r1.item_key
  left join food bf on bf.name = r1.item_key
  left join ek on ek.name_key = lower(trim(r1.mention)) left join eb es on es.p_partkey = ek.p_partkey),
r3 as (select *, item_key is not null as m,
    case when item_key is not null and bf_kcal is null then 'custom' when item_key is not null then 'built-in'
      else 'AI estimate' end as src,
    case when item_key is not null then item_key else lower(trim(mention)) end as item,
    case when item_key is not null then coalesce(cu_kcal, bf_kcal) else es_kcal end as p_kcal,
    case when item_key is not null then coalesce(cu_protein, bf_protein) else es_protein end as p_protein,
    case when item_key is not null then coalesce(cu_carbs, bf_carbs) else es_carbs end as p_carbs,
    case when item_key is not null then coalesce(cu_fat, bf_fat) else es_fat end as p_fat,
    lower(trim(coalesce(case when unit <> '' then unit end, 'serving'))) as u0
  from r2 where item_key is not null or es_kcal is not null),
r4 as (select r3.*, coalesce(s.unit, r3.u0) as cu from r3 left join unit_synonym s on s.alias = r3.u0),
r5 as (select r4.*,
    case when m and cu_kcal is not null then (select grams from eu where eu.p_partkey = r4.cu_pk and eu.unit = r4.cu)
         when m then (select grams from food_unit fu where fu.food_id = r4.bf_id and fu.unit = r4.cu)
         else (select grams from eu where eu.p_partkey = r4.es_pk and eu.unit = r4.cu) end as own,
    case when m and cu_kcal is not null then (select grams from eu where eu.p_partkey = r4.cu_pk and eu.unit = 'serving')
         when m then (select grams from food_unit fu where fu.food_id = r4.bf_id and fu.unit = 'serving')
         else (select grams from eu where eu.p_partkey = r4.es_pk and eu.unit = 'serving') end as serving,
    coalesce((select grams from fallback_grams fb where fb.unit = r4.cu), 100.0) as fallback
  from r4),
r6 as (select r5.*, cast(round_even(case when cu in ('g', 'ml') then cast(quantity as decimal(18,4))
      when cu in ('kg', 'l') then cast(quantity as decimal(18,4)) * 1000
      when own is not null then cast(quantity as decimal(18,4)) * cast(own as decimal(18,4))
      when cu in ('piece', 'plate', 'serving') and serving is not null
      then cast(quantity as decimal(18,4)) * cast(serving as decimal(18,4))
      else cast(quantity as decimal(18,4)) * cast(fallback as decimal(18,4)) end, 1) as double) as grams,
    (cu in ('g', 'ml', 'kg', 'l') or own is not null) as exact from r5)
""")


def _resolve_custom_sql():
    return resolve_custom_ctes() + f"""
select user_id, cast(day as varchar) as day, meal, meal_id, line, item, quantity, unit, grams,
  case when exact then src else src || ' (check grams)' end as source, src = 'AI estimate' as remember,
  {oracle.tot('p_kcal', 'grams')} as kcal, {oracle.tot('p_protein', 'grams')} as protein,
  {oracle.tot('p_carbs', 'grams')} as carbs, {oracle.tot('p_fat', 'grams')} as fat
from r6"""


@register("meal_resolve_custom", _resolve_custom_sql)
def q_meal_resolve_custom(spark, sf_dir):
    ch = dims.food_choice_df(spark)
    items = fx.meal_items(spark, sf_dir, ch)
    return food.resolve_with_custom(items, ch, dims.food_df(spark), fx.custom_foods(spark, sf_dir),
                                    fx.food_estimate_table(spark, sf_dir))


@register("day_log", lambda: oracle.with_ctes(f"""
select user_id, cast(day as varchar) as day, food_id, item, grams, kcal, protein, carbs, fat, line
from food_rows where day = date '{AS_OF}'"""))
def q_day_log(spark, sf_dir):
    """One day's food log rows (the day view lists them in entry order)."""
    r = food_rows(spark, sf_dir)
    return (r.where(F.col("day") == F.lit(AS_OF).cast("date"))
             .select("user_id", "day", "food_id", "item", "grams", "kcal", "protein", "carbs", "fat", "line"))


# --------------------------------------------- files, archives and commits


@register("band_file_import", lambda: ORACLE["band_csv_parse"])
def q_band_file_import(spark, sf_dir):
    """The export lines written as files to the shared folder and read back over byte
    ranges. Lines of every fourth user's sleep file end in a quoted field of two
    lines, which no metric uses."""
    from ..sources import band_csv, records
    from ..sources.storage import fresh
    lines = export_lines(spark, sf_dir).withColumn("text", F.when(
        (F.col("user_id") % 4 == 2) & (F.col("line_no") > 1) & F.col("file").endswith("shealth.sleep.csv"),
        F.concat("text", F.lit(',"a ""note"",\nof two lines"'))).otherwise(F.col("text")))
    root = fresh(spark, "export")
    records.write_lines(lines, root)
    return band_csv.daily_from_lines(band_csv.read_lines(spark, root, range_bytes=1 << 20))


@register("band_archive_import", lambda: oracle.with_ctes("""
, d as (select user_id, day from sleep_daily where user_id % 4 <> 3 union select user_id, day from heart_daily
  union select user_id, day from steps_daily union select user_id, day from stress_daily),
f as (select user_id, count(*) as files_used from (
  select distinct user_id, 's' as k from sleep_daily where user_id % 4 <> 3
  union all select distinct user_id, 'h' from heart_daily
  union all select distinct user_id, 'p' || reading_id % 2 from band_reading where metric = 'steps'
  union all select distinct user_id, 't' from stress_daily) x group by user_id)
select u.user_id, coalesce(a.days_saved, 0) as days_saved, coalesce(f.files_used, 0) as files_used,
  cast(case when u.user_id % 7 = 0 then 1 else 0 end as bigint) as archives_rejected
from (select distinct user_id from events where user_id is not null) u
left join (select user_id, count(*) as days_saved from d group by user_id) a on a.user_id = u.user_id
left join f on f.user_id = u.user_id"""))
def q_band_archive_import(spark, sf_dir):
    """One zip upload a user, written to the shared folder and read back member by
    member; every seventh user sends a second one that is cut short. Per user: days
    saved, files used and archives rejected."""
    from ..sources import archives, band_csv
    from ..sources.storage import fresh
    lines = export_lines(spark, sf_dir)
    root = fresh(spark, "uploads")
    archives.write_archives(lines, root)
    cut = lines.where(F.col("user_id") % 7 == 0).select("user_id").distinct()
    archives.write_broken(cut, root)
    back = archives.read_archives(spark, root)
    saved = band_csv.import_summary(back.where("error is null"))
    bad = archives.rejected(back).groupBy("user_id").agg(F.count("*").alias("archives_rejected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (back.select("user_id").distinct().join(saved, "user_id", "left").join(bad, "user_id", "left")
            .select("user_id", zero("days_saved"), zero("files_used"), zero("archives_rejected")))


# -------------------------------------------------------- ordered listings


@register("listing_supplements", lambda: oracle.with_ctes("""
select user_id, supplement_id, name, dose, timing, active,
  row_number() over (order by user_id, name, supplement_id, dose, timing, active) - 1 as position from supplements"""))
def q_listing_supplements(spark, sf_dir):
    """Supplements of every user in order of their name."""
    from ..operators import listing
    s = fx.supplements(spark, sf_dir)
    return listing.with_positions(s, ["user_id", "name", "supplement_id", "dose", "timing", "active"])


@register("listing_weights", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, kg, row_number() over (order by user_id, day) - 1 as position,
  row_number() over (partition by user_id order by day) as entry from weights"""))
def q_listing_weights(spark, sf_dir):
    """Weights of every user by date, with the number of the entry of its user."""
    from ..operators import listing
    w = fx.weights(spark, sf_dir).select("user_id", "day", "kg")
    return listing.with_positions(listing.numbered_within(w, ["user_id"], ["day"], "entry"), ["user_id", "day"])


@register("listing_lab_dates", lambda: oracle.with_ctes("""
select user_id, cast(test_date as varchar) as test_date, markers, row_number() over (order by user_id, test_date desc) - 1 as position
from (select user_id, test_date, count(*) as markers from lab_results group by user_id, test_date) x"""))
def q_listing_lab_dates(spark, sf_dir):
    """Lab reports of every user, the latest first."""
    from ..operators import listing
    r = fx.lab_results(spark, sf_dir).groupBy("user_id", "test_date").agg(F.count("*").alias("markers"))
    return listing.with_positions(r, ["user_id", F.col("test_date").desc()])


# ------------------------------------------------ names that keep their id


SAVED_SUPPLEMENTS_SQL = """
, named as (select user_id, name, min(supplement_id) as supplement_id, max(dose) as dose from supplements group by user_id, name),
old as (select * from named where supplement_id % 4 <> 1),
new as (select user_id, name, dose || ' x2' as dose from named where supplement_id % 2 = 1),
top as (select user_id, max(supplement_id) as top from old group by user_id),
added as (select n.user_id, n.name, n.dose, coalesce(t.top, -1) + row_number() over (partition by n.user_id order by n.name) as supplement_id
  from new n left join old o on o.user_id = n.user_id and o.name = n.name left join top t on t.user_id = n.user_id where o.name is null),
saved as (select o.user_id, o.supplement_id, o.name, coalesce(n.dose, o.dose) as dose, false as added
  from old o left join new n on n.user_id = o.user_id and n.name = o.name
  union all select user_id, supplement_id, name, dose, true from added)"""


def _saved_supplements(spark, sf_dir):
    from ..operators import snapshot
    named = (fx.supplements(spark, sf_dir).groupBy("user_id", "name")
             .agg(F.min("supplement_id").alias("supplement_id"), F.max("dose").alias("dose")))
    old = named.where("supplement_id % 4 <> 1").select("user_id", "supplement_id", "name", "dose")
    new = named.where("supplement_id % 2 = 1").select("user_id", "name", F.concat("dose", F.lit(" x2")).alias("dose"))
    return snapshot.upsert_by_name(old, new, ["user_id"], "name", "supplement_id")


@register("upsert_by_name", lambda: oracle.with_ctes(SAVED_SUPPLEMENTS_SQL + """
select user_id, supplement_id, name, dose, added from saved"""))
def q_upsert_by_name(spark, sf_dir):
    """Supplements saved again: a known name keeps its id, a new one gets the next."""
    return _saved_supplements(spark, sf_dir)


@register("log_after_upsert", lambda: oracle.with_ctes(SAVED_SUPPLEMENTS_SQL + """
select l.user_id, cast(l.day as varchar) as day, l.supplement_id, s.name, l.taken
from supplement_log l join saved s on s.user_id = l.user_id and s.supplement_id = l.supplement_id where not s.added"""))
def q_log_after_upsert(spark, sf_dir):
    """The supplement log still meets its supplements after they were saved again."""
    s = _saved_supplements(spark, sf_dir).where("not added").select("user_id", "supplement_id", "name")
    return (fx.supplement_log(spark, sf_dir).join(s, ["user_id", "supplement_id"])
            .select("user_id", "day", "supplement_id", "name", "taken"))


# ------------------------------------------------------- committed appends


@register("append_committed", lambda: oracle.with_ctes("""
select user_id, cast(day as varchar) as day, kg, case when day(day) % 3 = 0 then 'late' else 'early' end as batch from weights"""))
def q_append_committed(spark, sf_dir):
    """Two batches of weights appended to a table, the second one twice."""
    from ..operators import commits
    from ..sources.storage import fresh
    w = fx.weights(spark, sf_dir).select("user_id", "day", "kg")
    table = fresh(spark, "weights")
    late = w.where(F.dayofmonth("day") % 3 == 0)
    commits.append_batch(w.where(F.dayofmonth("day") % 3 != 0), table, "early")
    commits.append_batch(late, table, "late")
    commits.append_batch(late, table, "late")
    return commits.read_committed(spark, table)
