"""Reference SQL (DuckDB dialect) for the correctness gate.

Each query here is written independently of the Spark code, straight from
the semantics, over the same driver tables. The derived inputs are CTEs; the
fixed dimensions are inline VALUES generated from ``sources.dims``.
"""
from __future__ import annotations

from ..sources import dims

FIXTURE_CTES = {
    "profile": """
select c_custkey as user_id, c_name as name, cast(14 + c_custkey % 77 as int) as age,
  case when c_custkey % 2 = 0 then 'Male' else 'Female' end as sex,
  cast(120 + c_custkey % 111 as double) as height_cm,
  case c_custkey % 6 when 0 then 'Sedentary' when 1 then 'Light (1-3 workouts/week)'
    when 2 then 'Moderate (3-5 workouts/week)' when 3 then 'Very active (6-7 workouts/week)'
    when 4 then 'Athlete (2x/day or physical job)' else 'Unlisted' end as activity,
  cast(c_custkey % 31 as double) as deficit_pct,
  cast(12 + c_custkey % 15 as double) / 10 as protein_g_per_kg from customer""",
    "weights": """
select user_id, day, cast(kg as double) as kg from (
  select user_id, cast(ts as date) as day,
    cast(60 + user_id % 40 as double) + cast(event_id % 30 as double) / 10 as kg,
    row_number() over (partition by user_id, cast(ts as date) order by event_id desc) as rn
  from events where event_type in ('click', 'view')) x where rn = 1""",
    "food_log": """
select l_suppkey as user_id, date '2024-01-01' + cast(l_orderkey % 30 as int) as day,
  l_partkey % 61 as food_id, l_quantity * 5 as grams, l_linenumber as line from lineitem""",
    "workout_log": """
select l_suppkey as user_id, date '2024-01-01' + cast(l_orderkey % 30 as int) as day,
  l_partkey % 48 as exercise_id, 1 + l_linenumber % 5 as sets, cast(l_quantity as int) % 13 as reps,
  cast(l_partkey % 41 as double) * 2.5 as weight_kg, 5.0::double + (l_partkey % 12) / 2 as rpe,
  l_orderkey * 8 + l_linenumber as entry from lineitem""",
    "band_reading": """
select event_id * 4 + k as reading_id, user_id, ts + k * interval '17 minutes' as ts,
  case when event_type in ('view', 'click', 'purchase') then 'heart_rate' when event_type = 'signup' then 'stress' else 'steps' end as metric,
  case when event_type in ('view', 'click', 'purchase') then 25 + value + k
       when event_type = 'signup' then least(value, 100) else value * 100 + k end as value
from events, (values (0), (1), (2), (3)) z(k)""",
    "sleep_session": """
select event_id, user_id, ts as start_time, ts + (event_id % 20) * interval '1 hour' as end_time,
  case when event_id % 3 = 0 then null else least(value, 100) end as sleep_score,
  case event_id % 4 when 0 then 'UTC+0530' when 1 then 'UTC-0800' when 2 then 'UTC+05:30' else null end as time_offset
from events where event_type in ('error', 'purchase')""",
    "supplements": """
select p_partkey % n + 1 as user_id, p_partkey // n as supplement_id, p_name as name, cast(p_size as varchar) as dose,
  p_type as timing, case when (p_partkey // n) % 5 = 0 then 0 else 1 end as active
from part, (select count(*) as n from supplier)""",
    "supplement_log": """
select user_id, day, supplement_id, max(taken) as taken from (
  select l_suppkey as user_id, date '2024-01-01' + cast(l_orderkey % 30 as int) as day, l_partkey % 12 as supplement_id,
    case when l_returnflag = 'N' then 0 else 1 end as taken from lineitem) x group by user_id, day, supplement_id""",
    "lab_results": """
select o_custkey as user_id, cast(o_orderdate as date) as test_date, p_type as marker, l_quantity as value,
  case when p_size % 5 = 0 then null else cast(p_size % 20 as double) end as ref_low,
  case when p_size % 7 = 0 then null else cast(20 + p_size % 25 as double) end as ref_high,
  l_linenumber as line, l_orderkey as report_id
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
}

DIM_CTES = {
    "food": dims.food_sql,
    "food_unit": dims.food_unit_sql,
    "food_choice": dims.food_choice_sql,
    "exercise": dims.exercise_sql,
    "activity_dim": dims.activity_sql,
    "unit_synonym": dims.unit_synonym_sql,
    "fallback_grams": dims.fallback_grams_sql,
    "equipment_kind": dims.equipment_kind_sql,
}



def tot(per100: str, grams: str) -> str:
    """Nutrient total, 1 decimal, half-even in decimal arithmetic."""
    return (f"cast(round_even(cast({per100} as decimal(18,4)) * cast({grams} as decimal(18,4)) * 0.01, 1) "
            "as double)")


# Derived layers shared by several oracle queries.
LAYER_CTES = {
    "food_rows": f"""
select f.user_id, f.day, f.food_id, f.grams, f.line, d.name as item,
  {tot('d.kcal', 'f.grams')} as kcal, {tot('d.protein', 'f.grams')} as protein,
  {tot('d.carbs', 'f.grams')} as carbs, {tot('d.fat', 'f.grams')} as fat
from food_log f join food d on f.food_id = d.food_id""",
    "sleep_x": """
select user_id, sleep_score, st + to_minutes(off) as s, en + to_minutes(off) as e from (
  select user_id, sleep_score, start_time as st, end_time as en,
    coalesce(case regexp_extract(coalesce(time_offset, ''), 'UTC([+-])(\\d{2})(\\d{2})', 1)
               when '+' then 1 when '-' then -1 end
             * (cast(nullif(regexp_extract(coalesce(time_offset, ''), 'UTC([+-])(\\d{2})(\\d{2})', 2), '') as int) * 60
                + cast(nullif(regexp_extract(coalesce(time_offset, ''), 'UTC([+-])(\\d{2})(\\d{2})', 3), '') as int)), 0) as off
  from sleep_session) y""",
    "sleep_daily": """
select user_id, cast(e as date) as day, sum(epoch_us(e) - epoch_us(s)) / 3600000000 as sleep_hours,
  case when count(sleep_score) > 0 then cast(sum(cast(sleep_score as decimal(18,4))) as double) / count(sleep_score) end as sleep_score
from sleep_x where epoch_us(e) - epoch_us(s) > 0 and epoch_us(e) - epoch_us(s) < 16 * 3600000000
group by user_id, cast(e as date)""",
    "heart_daily": """
select user_id, cast(ts as date) as day, round_even(quantile_cont(value, 0.05), 4) as resting_hr
from band_reading where metric = 'heart_rate' and value > 30 and value < 220
group by user_id, cast(ts as date) having count(value) >= 6""",
    "steps_daily": """
select user_id, cast(ts as date) as day, cast(round_even(max(value), 0) as bigint) as steps
from band_reading where metric = 'steps' group by user_id, cast(ts as date)""",
    "stress_daily": """
select user_id, cast(ts as date) as day,
  case when count(value) > 0 then cast(sum(cast(value as decimal(18,4))) as double) / count(value) end as stress
from band_reading where metric = 'stress' group by user_id, cast(ts as date)""",
    "band_daily": """
select user_id, day, max(sleep_hours) as sleep_hours, max(sleep_score) as sleep_score,
  max(resting_hr) as resting_hr, max(steps) as steps, max(stress) as stress from (
  select user_id, day, sleep_hours, sleep_score, null::double as resting_hr, null::bigint as steps, null::double as stress from sleep_daily
  union all select user_id, day, null, null, resting_hr, null, null from heart_daily
  union all select user_id, day, null, null, null, steps, null from steps_daily
  union all select user_id, day, null, null, null, null, stress from stress_daily) u
group by user_id, day""",
}


def with_ctes(tail: str) -> str:
    """Prefix ``tail`` with every input CTE. ``tail`` is either a SELECT or
    starts with ``,`` to add more CTEs before its own SELECT."""
    parts = []
    for name, body in FIXTURE_CTES.items():
        parts.append(f"{name} AS ({body.strip()})")
    for name, fn in DIM_CTES.items():
        parts.append(f"{name} AS {fn()}")
    for name, body in LAYER_CTES.items():
        parts.append(f"{name} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n" + tail.strip()


def targets_cols(w: str) -> str:
    """SQL columns bmr, tdee, kcal, protein, fat, carbs, floored for profile
    alias ``p`` joined with activity_dim alias ``a`` and weight expr ``w``."""
    bmr = f"(10 * {w} + 6.25 * p.height_cm - 5 * p.age + case when p.sex = 'Male' then 5 else -161 end)"
    tdee = f"({bmr} * coalesce(a.multiplier, 1.55))"
    kcal = f"greatest({tdee} * (1 - p.deficit_pct / 100), {bmr})"
    protein = f"({w} * p.protein_g_per_kg)"
    fat = f"greatest(0.8 * {w}, 0.25 * {kcal} / 9)"
    carbs = f"greatest(({kcal} - {protein} * 4 - {fat} * 9) / 4, 0.0)"
    return (f"{bmr} as bmr, {tdee} as tdee, {kcal} as kcal, {protein} as protein, "
            f"{carbs} as carbs, {fat} as fat, ({kcal} = {bmr}) as floored")


WEEK_STATS = """
, fd as (
  select user_id, day, cast(date_trunc('week', day) as date) as week_start,
    sum(cast(kcal as decimal(18,1))) as kcal, sum(cast(protein as decimal(18,1))) as protein
  from food_rows group by user_id, day),
wk as (
  select user_id, week_start from fd
  union select user_id, cast(date_trunc('week', day) as date) from weights
  union select user_id, cast(date_trunc('week', day) as date) from band_daily
  union select user_id, cast(date_trunc('week', day) as date) from workout_log
  union select user_id, cast(date_trunc('week', day) as date) from supplement_log),
wt as (
  select s.user_id, s.week_start, arg_max(w.kg, w.day) as kg
  from wk s join weights w on w.user_id = s.user_id and w.day <= s.week_start + 6
  group by s.user_id, s.week_start),
tg as (
  select wt.user_id, wt.week_start, t.kcal as t_kcal, t.protein as t_protein from wt
  join (select p.user_id, wt2.week_start, {targets} from profile p
        left join activity_dim a on a.activity = p.activity
        join wt wt2 on wt2.user_id = p.user_id) t
    on t.user_id = wt.user_id and t.week_start = wt.week_start),
fw as (
  select fd.user_id, fd.week_start, count(*) as days_food_logged,
    cast(sum(fd.kcal) as double) / count(*) as a_kcal, cast(sum(fd.protein) as double) / count(*) as a_protein,
    count(*) filter (where fd.protein >= 0.9 * tg.t_protein) as hit
  from fd left join tg on tg.user_id = fd.user_id and tg.week_start = fd.week_start
  group by fd.user_id, fd.week_start),
ww as (
  select user_id, cast(date_trunc('week', day) as date) as week_start, arg_min(kg, day) as w0, arg_max(kg, day) as w1
  from weights group by 1, 2),
bw as (
  select user_id, cast(date_trunc('week', day) as date) as week_start,
    case when count(sleep_hours) > 0 then cast(sum(cast(sleep_hours as decimal(18,6))) as double) / count(sleep_hours) end as sl,
    case when count(resting_hr) > 0 then cast(sum(cast(resting_hr as decimal(18,4))) as double) / count(resting_hr) end as rh,
    case when count(steps) > 0 then cast(sum(cast(steps as decimal(18,0))) as double) / count(steps) end as stp
  from band_daily group by 1, 2),
lw as (
  select user_id, cast(date_trunc('week', day) as date) as week_start, count(distinct day) as training_days,
    cast(sum(sets) as bigint) as total_working_sets from workout_log group by 1, 2),
sw as (
  select user_id, cast(date_trunc('week', day) as date) as week_start, cast(sum(taken) as bigint) as taken
  from supplement_log group by 1, 2),
na as (select user_id, count(*) filter (where active = 1) as n from supplements group by user_id)
select wk.user_id, cast(wk.week_start as varchar) as week_start,
  cast(wk.week_start as varchar) || ' to ' || cast(wk.week_start + 6 as varchar) as week,
  cast(coalesce(fw.days_food_logged, 0) as bigint) as days_food_logged,
  round_even(fw.a_kcal, 0) as avg_calories, round_even(tg.t_kcal, 0) as calorie_target,
  round_even(fw.a_protein, 0) as avg_protein_g, round_even(tg.t_protein, 0) as protein_target_g,
  cast(coalesce(fw.hit, 0) as bigint) as days_protein_target_hit,
  cast(coalesce(lw.training_days, 0) as bigint) as training_days,
  cast(coalesce(lw.total_working_sets, 0) as bigint) as total_working_sets,
  round_even(ww.w0, 1) as weight_start_kg, round_even(ww.w1, 1) as weight_end_kg,
  round_even(bw.sl, 1) as avg_sleep_hours, round_even(bw.rh, 0) as avg_resting_hr, round_even(bw.stp, 0) as avg_steps,
  case when na.n > 0 then cast(round_even(100 * coalesce(sw.taken, 0) / (7 * na.n), 0) as bigint) end as supplement_adherence_pct
from wk
left join fw on fw.user_id = wk.user_id and fw.week_start = wk.week_start
left join tg on tg.user_id = wk.user_id and tg.week_start = wk.week_start
left join ww on ww.user_id = wk.user_id and ww.week_start = wk.week_start
left join bw on bw.user_id = wk.user_id and bw.week_start = wk.week_start
left join lw on lw.user_id = wk.user_id and lw.week_start = wk.week_start
left join sw on sw.user_id = wk.user_id and sw.week_start = wk.week_start
left join na on na.user_id = wk.user_id
"""


def week_stats_sql() -> str:
    return with_ctes(WEEK_STATS.replace("{targets}", targets_cols("wt2.kg")))


def _token_sort_sql(expr: str, lower: bool) -> str:
    x = f"lower(trim({expr}))" if lower else f"trim({expr})"
    return (f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')), ' ')")


def fuzzy_sql(queries: str, qcol: str, choices: str, ccol: str, ocol: str, cutoff: float,
              lower: bool, keys: tuple[str, ...] = (), payload: tuple[str, ...] = (), prefix: str = "fz") -> str:
    """Brute-force best match over all (query, choice) pairs with the same
    keys: CTE text ``fz_best`` with keys, query, matched, ord, payload, score."""
    kq = ", ".join(f"q.{k}" for k in keys)
    kj = " and ".join(f"q.{k} = c.{k}" for k in keys) or "true"
    ksel = (kq + ", ") if keys else ""
    pay = "".join(f", c.{p}" for p in payload)
    pay_b = "".join(f", b.{p}" for p in payload)
    part = ", ".join([f"q.{k}" for k in keys] + ["q.q"])
    lj = " and ".join([f"b.{k} = d.{k}" for k in keys] + ["b.q = d.q"])
    return (f"""
, fz_q as (select distinct {ksel}{qcol} as q from {queries} q where {qcol} is not null),
fz_qn as (select *, {_token_sort_sql('q', lower)} as qn from fz_q),
fz_c as (select *, {_token_sort_sql(ccol, False)} as cn from {choices}),
fz_cm as (select *, length(cn) as cl,
  map_from_entries(list_transform(list_distinct(string_split(cn, '')), lambda ch: {{'k': ch,
    'v': list_reduce(list_transform(range(length(cn)), lambda i: case when cn[i + 1] = ch then (1::bigint << i) else 0::bigint end),
                     lambda a, b: a | b, 0::bigint)}})) as masks from fz_c),
fz_p as (
  select {ksel}q.q, c.{ccol} as matched, c.{ocol} as ord{pay}, length(q.qn) as ql, c.cl,
    c.cl - bit_count(list_reduce(string_split(q.qn, ''),
      lambda v, ch: ((v + (v & coalesce(c.masks[ch], 0::bigint))) | (v - (v & coalesce(c.masks[ch], 0::bigint))))
                    & ((1::bigint << c.cl) - 1), (1::bigint << c.cl) - 1)) as lcs
  from fz_qn q join fz_cm c on {kj}),
fz_s as (
  select q.*, 200.0 * lcs / (ql + cl) as score,
    row_number() over (partition by {part} order by 200.0 * lcs / (ql + cl) desc, ord) as rn
  from fz_p q where 200 * lcs >= {cutoff} * (ql + cl)),
fz_best as (
  select {", ".join(f"d.{k}" for k in keys) + ", " if keys else ""}d.q, b.matched, b.ord{pay_b}, b.score
  from fz_q d left join (select * from fz_s where rn = 1) b on {lj})""").replace("fz_", prefix + "_")
