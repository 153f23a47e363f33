"""Body, vitals, cardio, nutrition and dashboard queries."""

from pyspark.sql import functions as F

from vitalspark.functions import (
    km_to_miles, metres_to_km, pace_text, round_to_int, week_start, zero_to_null,
)
from vitalspark.functions.health import bp_class
from vitalspark.functions.numbers import kg_to_lbs
from vitalspark.operators import body_health, cardio_nutrition, dashboard
from vitalspark.plans import marts
from vitalspark.plans.catalog import query
from vitalspark.plans.strength_queries import WEEKLY
from vitalspark.sources.domain import AS_OF


def mean_sql(column: str, digits: int, scale: int = 0) -> str:
    """Exact rounded mean of a non-negative column, in whole numbers."""
    unit = 10**scale
    total = f"cast(sum({column} * {unit}) as bigint)"
    n = f"count({column})"
    steps = unit if digits == 0 else unit // 10 if unit >= 10 else 0
    if digits == 1 and scale == 0:
        body = f"((20 * {total} + {n}) // (2 * {n})) / 10.0"
    elif digits == 1:
        body = f"((2 * {total} + {steps} * {n}) // (2 * {steps} * {n})) / 10.0"
    else:
        body = f"(2 * {total} + {steps} * {n}) // (2 * {steps} * {n})"
    return f"case when {n} > 0 then {body} end"


NUTRITION = """
select {k} log_date, sum(calories_kcal) as total_calories, sum(protein_g) as total_protein_g,
  sum(carbs_g) as total_carbs_g, sum(fat_g) as total_fat_g, sum(fiber_g) as total_fiber_g,
  count(*) as entry_count
from nutrition_log group by {k} log_date"""
NUTRITION_COLUMNS = (
    "log_date:d total_calories:n total_protein_g:f total_carbs_g:f total_fat_g:f"
    " total_fiber_g:f entry_count:n"
)
query("daily_nutrition", f"user_id:n {NUTRITION_COLUMNS}", "nutrition_log", NUTRITION.format(k="user_id,"))(
    cardio_nutrition.daily_nutrition
)
query("daily_nutrition_all_users", NUTRITION_COLUMNS, "nutrition_log", NUTRITION.format(k=""))(
    lambda t: cardio_nutrition.daily_nutrition(t, keys=())
)

CARDIO = """
select {k} cast(date_trunc('week', session_date) as date) as week_start, activity_type,
  count(*) as session_count, round(sum(distance_km), 2) as total_km, sum(duration_min) as total_min,
  sum(steps) as total_steps
from cardio_sessions group by {k} cast(date_trunc('week', session_date) as date), activity_type"""
CARDIO_COLUMNS = "week_start:d activity_type:s session_count:n total_km:f total_min:n total_steps:n"
query("weekly_cardio", f"user_id:n {CARDIO_COLUMNS}", "cardio_sessions", CARDIO.format(k="user_id,"))(
    cardio_nutrition.weekly_cardio
)
query("weekly_cardio_all_users", CARDIO_COLUMNS, "cardio_sessions", CARDIO.format(k=""))(
    lambda t: cardio_nutrition.weekly_cardio(t, keys=())
)
query(
    "cardio_by_day", "user_id:n date:d distance_km:f", "cardio_sessions",
    """select user_id, session_date as date, coalesce(sum(distance_km), 0) as distance_km
       from cardio_sessions group by user_id, session_date""",
)(cardio_nutrition.cardio_by_day)
query(
    "filter_since", "id:n user_id:n session_date:d activity_type:s", "cardio_sessions",
    f"select * from cardio_sessions where session_date >= date '{AS_OF}' - 7",
)(lambda t: cardio_nutrition.filter_since(t["cardio_sessions"], "session_date", AS_OF, 7))

SLEEP = f"""
select user_id, cast(date_trunc('week', session_date) as date) as week_start, count(*) as nights,
  {mean_sql("duration_min", 0)} as avg_sleep_min, {mean_sql("deep_min", 0, 1)} as avg_deep_min,
  {mean_sql("rem_min", 0, 1)} as avg_rem_min, {mean_sql("efficiency_pct", 1, 2)} as avg_efficiency,
  {mean_sql("sleep_score", 1)} as avg_sleep_score
from sleep_sessions group by user_id, cast(date_trunc('week', session_date) as date)"""
query(
    "weekly_sleep",
    "user_id:n week_start:d nights:n avg_sleep_min:f avg_deep_min:f avg_rem_min:f"
    " avg_efficiency:f avg_sleep_score:f",
    "sleep_sessions",
    SLEEP,
)(body_health.weekly_sleep)
SPO2 = f"""select user_id, measurement_date, {mean_sql("spo2_pct", 1, 2)} as avg_spo2
from blood_oxygen group by user_id, measurement_date"""
STRESS = f"""select user_id, measurement_date, {mean_sql("stress_score", 1)} as avg_stress
from stress_readings group by user_id, measurement_date"""
query("daily_spo2", "user_id:n measurement_date:d avg_spo2:f", "blood_oxygen", SPO2)(
    body_health.daily_spo2
)
query("daily_stress", "user_id:n measurement_date:d avg_stress:f", "stress_readings", STRESS)(
    body_health.daily_stress
)

TREND = """
select * from (select *, row_number() over (partition by {k} measurement_date
    order by created_at desc nulls first, id desc) as place
  from body_metrics where weight_lbs is not null) where place = 1"""
TREND_COLUMNS = "measurement_date:d weight_lbs:f body_fat_pct:f muscle_mass_lbs:f bmi:f source:s"
query("weight_trend", f"user_id:n {TREND_COLUMNS}", "body_metrics", TREND.format(k="user_id,"))(
    body_health.weight_trend
)
query("weight_trend_all_users", TREND_COLUMNS, "body_metrics", TREND.format(k=""))(
    lambda t: body_health.weight_trend(t, keys=())
)
query(
    "weight_series", "user_id:n date:d weight_lbs:f", "body_metrics",
    f"""select user_id, measurement_date as date, weight_lbs from body_metrics
        where weight_lbs is not null and measurement_date >= date '{AS_OF}' - 30""",
)(lambda t: body_health.weight_series(t, AS_OF))
LATEST = """
select * from (select *, row_number() over (partition by user_id
    order by measured_at desc, id desc) as place
  from body_metrics where weight_lbs is not null) where place = 1"""
query(
    "latest_metric",
    "user_id:n id:n measured_at:t measurement_date:d weight_lbs:f body_fat_pct:f bmi:f source:s",
    "body_metrics",
    LATEST,
)(body_health.latest_metric)
PRESSURE = """
select * from (select *, row_number() over (partition by user_id, measurement_date
    order by measured_at desc, id desc) as place from blood_pressure) where place = 1"""
query(
    "last_bp_per_day", "user_id:n measurement_date:d systolic_mmhg:n diastolic_mmhg:n",
    "blood_pressure", PRESSURE,
)(body_health.last_bp_per_day)
NIGHT = """
select * from (select *, row_number() over (partition by user_id, session_date
    order by sleep_end desc, id desc) as place from sleep_sessions) where place = 1"""
query(
    "one_sleep_per_night",
    "user_id:n session_date:d duration_min:n deep_min:f rem_min:f light_min:f efficiency_pct:f sleep_score:n",
    "sleep_sessions",
    NIGHT,
)(body_health.one_sleep_per_night)

HR = """
select {k} summary_date, resting_bpm, hrv_ms,
  (2 * cast(sum(resting_bpm * 10) over w as bigint) + count(*) over w)
    // (2 * count(*) over w) / 10.0 as rolling_7day_avg
from heart_rate_daily where resting_bpm is not null
window w as ({p} order by summary_date, resting_bpm, hrv_ms rows between 6 preceding and current row)"""
query(
    "hr_trend", "user_id:n summary_date:d resting_bpm:f rolling_7day_avg:f hrv_ms:f",
    "heart_rate_daily", HR.format(k="user_id,", p="partition by user_id"),
)(body_health.hr_trend)
query(
    "hr_trend_all_users", "summary_date:d resting_bpm:f rolling_7day_avg:f hrv_ms:f",
    "heart_rate_daily", HR.format(k="", p=""),
)(lambda t: body_health.hr_trend(t, keys=()))

BP_CASE = """case when systolic_mmhg < 120 and diastolic_mmhg < 80 then 'Normal'
    when systolic_mmhg < 130 and diastolic_mmhg < 80 then 'Elevated'
    when systolic_mmhg < 140 or diastolic_mmhg < 90 then 'High Stage 1'
    when systolic_mmhg >= 140 or diastolic_mmhg >= 90 then 'High Stage 2'
    else 'Unknown' end"""
query(
    "blood_pressure_log",
    "user_id:n measured_at:t measurement_date:d systolic_mmhg:n diastolic_mmhg:n pulse_bpm:n"
    " classification:s source:s notes:s",
    "blood_pressure",
    f"select *, {BP_CASE} as classification from blood_pressure",
)(body_health.blood_pressure_log)
query(
    "bp_classification", "classification:s readings:n", "blood_pressure",
    f"select {BP_CASE} as classification, count(*) as readings from blood_pressure group by 1",
)(
    lambda t: t["blood_pressure"]
    .groupBy(bp_class(F.col("systolic_mmhg"), F.col("diastolic_mmhg")).alias("classification"))
    .agg(F.count(F.lit(1)).alias("readings"))
)

PACE = """case when avg_pace_sec_km is not null then
  lpad(cast((avg_pace_sec_km // 60) % 60 as varchar), 2, '0') || ':'
  || lpad(cast(avg_pace_sec_km % 60 as varchar), 2, '0') end"""
query(
    "samsung_workout_history",
    "user_id:n session_date:d activity_type:s duration_min:n distance_km:f calories:n avg_hr_bpm:f"
    " max_hr_bpm:n avg_pace:s avg_speed_kmh:f elevation_gain_m:f vo2_max:f workout_score:n source:s",
    "samsung_workouts",
    f"""select *, round(distance_m * cast(0.001 as decimal(4,3)), 2) as distance_km, {PACE} as avg_pace
        from samsung_workouts""",
)(body_health.samsung_workout_history)
query(
    "pace_format", "id:n avg_pace:s", "samsung_workouts",
    f"select id, {PACE} as avg_pace from samsung_workouts",
)(lambda t: t["samsung_workouts"].select("id", pace_text(F.col("avg_pace_sec_km")).alias("avg_pace")))

ACTIVITY = """a.steps, round(a.distance_m * cast(0.001 as decimal(4,3)), 2) as distance_km, a.calories_active,
  a.calories_total, a.active_min, a.floors_climbed, a.vo2_max as vo2_max_daily"""
REST = """h.resting_bpm, h.min_bpm, h.max_bpm, h.hrv_ms, b.systolic_mmhg, b.diastolic_mmhg, o.avg_spo2,
  s.avg_stress, l.duration_min as sleep_min, l.deep_min, l.rem_min, l.light_min,
  l.efficiency_pct as sleep_efficiency, l.sleep_score"""
HEALTH_TABLES = (
    "daily_activity heart_rate_daily blood_pressure blood_oxygen stress_readings sleep_sessions"
)
HEALTH_COLUMNS = (
    "user_id:n summary_date:d steps:n distance_km:f calories_active:n calories_total:n active_min:n"
    " floors_climbed:n vo2_max_daily:f resting_bpm:f min_bpm:n max_bpm:n hrv_ms:f systolic_mmhg:n"
    " diastolic_mmhg:n avg_spo2:f avg_stress:f sleep_min:n deep_min:f rem_min:f light_min:f"
    " sleep_efficiency:f sleep_score:n"
)
STRICT = f"""
select coalesce(a.user_id, h.user_id, b.user_id, o.user_id, s.user_id, l.user_id) as user_id,
  coalesce(a.activity_date, b.measurement_date, h.summary_date) as summary_date, {ACTIVITY}, {REST}
from daily_activity a
full join heart_rate_daily h on h.user_id = a.user_id and h.summary_date = a.activity_date
full join ({PRESSURE}) b on b.user_id = a.user_id and b.measurement_date = a.activity_date
full join ({SPO2}) o on o.user_id = a.user_id and o.measurement_date = a.activity_date
full join ({STRESS}) s on s.user_id = a.user_id and s.measurement_date = a.activity_date
full join ({NIGHT}) l on l.user_id = a.user_id and l.session_date = a.activity_date - 1"""
ALIGNED = f"""
with spine as (
  select user_id, activity_date as d from daily_activity
  union select user_id, summary_date from heart_rate_daily
  union select user_id, measurement_date from blood_pressure
  union select user_id, measurement_date from blood_oxygen
  union select user_id, measurement_date from stress_readings
  union select user_id, session_date + 1 from sleep_sessions)
select x.user_id, x.d as summary_date, {ACTIVITY}, {REST}
from spine x
left join daily_activity a on a.user_id = x.user_id and a.activity_date = x.d
left join heart_rate_daily h on h.user_id = x.user_id and h.summary_date = x.d
left join ({PRESSURE}) b on b.user_id = x.user_id and b.measurement_date = x.d
left join ({SPO2}) o on o.user_id = x.user_id and o.measurement_date = x.d
left join ({STRESS}) s on s.user_id = x.user_id and s.measurement_date = x.d
left join ({NIGHT}) l on l.user_id = x.user_id and l.session_date + 1 = x.d"""
query("daily_health_summary", HEALTH_COLUMNS, HEALTH_TABLES, STRICT)(body_health.daily_health_summary)
query("daily_health_summary_aligned", HEALTH_COLUMNS, HEALTH_TABLES, ALIGNED)(
    lambda t: body_health.daily_health_summary(t, mode="aligned")
)

FEED = """
select user_id, session_date as date, 'Workout' as type,
  name || case when duration_min is not null then ' · ' || duration_min || 'min' else '' end as detail, id
from workout_sessions
union all
select user_id, session_date, 'Cardio', activity_type || case when distance_km is not null
  then ' · ' || cast(round(distance_km * cast(0.621371 as decimal(6,6)), 2) as varchar) || 'mi' else '' end, id
from cardio_sessions
union all
select user_id, measurement_date, 'Weight', cast(weight_lbs as varchar) || ' lbs'
  || case when body_fat_pct is not null then ' · ' || cast(body_fat_pct as varchar) || '% BF' else '' end, id
from body_metrics where weight_lbs is not null"""
FEED_TABLES = "workout_sessions cardio_sessions body_metrics"
query("activity_feed", "user_id:n date:d type:s detail:s", FEED_TABLES, FEED)(
    lambda t: dashboard.activity_feed(t, top=None)
)
query(
    "recent_activity_topk", "user_id:n date:d type:s detail:s", FEED_TABLES,
    f"""select * from (select *, row_number() over (partition by user_id order by date desc, type, id) as place
        from ({FEED})) where place <= 10""",
)(dashboard.recent_activity_topk)

query(
    "dashboard_summary",
    "user_id:n workouts_count:n workouts_total_min:n cardio_count:n cardio_total_km:f"
    " cardio_total_steps:n weight_lbs:f body_fat_pct:f bmi:f measurement_date:d"
    " nutrition_calories:n nutrition_protein_g:f nutrition_entry_count:n",
    "users workout_sessions cardio_sessions body_metrics nutrition_log",
    f"""
    select u.id as user_id, coalesce(w.n, 0) as workouts_count, coalesce(w.m, 0) as workouts_total_min,
      coalesce(c.n, 0) as cardio_count, coalesce(c.km, 0) as cardio_total_km,
      coalesce(c.st, 0) as cardio_total_steps, m.weight_lbs, m.body_fat_pct, m.bmi, m.measurement_date,
      coalesce(f.kcal, 0) as nutrition_calories, coalesce(f.p, 0) as nutrition_protein_g,
      coalesce(f.n, 0) as nutrition_entry_count
    from users u
    left join (select user_id, count(*) as n, sum(duration_min) as m from workout_sessions
      where session_date >= date '{AS_OF}' - 7 group by user_id) w on w.user_id = u.id
    left join (select user_id, count(*) as n, sum(distance_km) as km, sum(steps) as st from cardio_sessions
      where session_date >= date '{AS_OF}' - 7 group by user_id) c on c.user_id = u.id
    left join ({LATEST}) m on m.user_id = u.id
    left join (select user_id, sum(calories_kcal) as kcal, round(sum(protein_g), 1) as p, count(*) as n
      from nutrition_log where log_date = date '2024-01-30' group by user_id) f on f.user_id = u.id""".replace(
        f"date '{AS_OF}' - 7", "date '2024-01-30' - 7"
    ),
)(lambda t: dashboard.dashboard_summary(t, "2024-01-30"))

# ---- scalar families over whole tables ----
query(
    "week_start", "id:n week_start:d", "workout_sessions",
    "select id, cast(date_trunc('week', session_date) as date) as week_start from workout_sessions",
)(lambda t: t["workout_sessions"].select("id", week_start(F.col("session_date")).alias("week_start")))
query(
    "date_arithmetic", "id:n day_before:d week_before:d month_after:d", "workout_sessions",
    """select id, session_date - 1 as day_before, session_date - 7 as week_before,
         session_date + 30 as month_after from workout_sessions""",
)(
    lambda t: t["workout_sessions"].select(
        "id", F.date_sub("session_date", 1).alias("day_before"),
        F.date_sub("session_date", 7).alias("week_before"),
        F.date_add("session_date", 30).alias("month_after"),
    )
)
query(
    "unit_conversion", "id:n km:f miles:f pounds:f", "samsung_workouts",
    """select id, round(distance_m * cast(0.001 as decimal(4,3)), 2) as km,
         round(avg_speed_kmh * cast(0.621371 as decimal(6,6)), 2) as miles,
         round(avg_speed_kmh * cast(2.20462 as decimal(6,5)), 2) as pounds from samsung_workouts""",
)(
    lambda t: t["samsung_workouts"].select(
        "id", metres_to_km(F.col("distance_m")).alias("km"),
        km_to_miles(F.col("avg_speed_kmh")).alias("miles"),
        kg_to_lbs(F.col("avg_speed_kmh")).alias("pounds"),
    )
)
query(
    "rounding", "id:n whole:n one:f", "cardio_sessions",
    """select id, cast(floor(distance_km + 0.5) as bigint) as whole, round(distance_km, 1) as one
       from cardio_sessions""",
)(
    lambda t: t["cardio_sessions"].select(
        "id", round_to_int(F.col("distance_km")).alias("whole"), F.round("distance_km", 1).alias("one")
    )
)
query(
    "null_handling", "id:n steps:n minutes:n known:b", "cardio_sessions",
    """select id, nullif(coalesce(steps, 0), 0) as steps, coalesce(duration_min, 0) as minutes,
         case when distance_km is not null then true end as known from cardio_sessions""",
)(
    lambda t: t["cardio_sessions"].select(
        "id", zero_to_null(F.coalesce("steps", F.lit(0))).alias("steps"),
        F.coalesce("duration_min", F.lit(0)).alias("minutes"),
        F.when(F.col("distance_km").isNotNull(), True).alias("known"),
    )
)
query(
    "decimal_to_text", "id:n shown:s", "body_metrics",
    "select id, cast(weight_lbs as varchar) || ' lbs' as shown from body_metrics",
)(lambda t: t["body_metrics"].select("id", F.concat(F.col("weight_lbs").cast("string"), F.lit(" lbs")).alias("shown")))
query("nulls_last_order", HEALTH_COLUMNS, HEALTH_TABLES, STRICT)(
    lambda t: body_health.daily_health_summary(t).orderBy(F.col("summary_date").desc_nulls_last())
)
query("ordered_marts", f"user_id:n {NUTRITION_COLUMNS}", "nutrition_log", NUTRITION.format(k="user_id,"))(
    lambda t: marts.ordered("daily_nutrition", t)
)
query(
    "publish_marts", "mart:s user_id:n period:d measure:f",
    "nutrition_log workout_sessions cardio_sessions sleep_sessions body_metrics",
    f"""
    select 'daily_nutrition' as mart, user_id, log_date as period, cast(total_calories as double) as measure
    from ({NUTRITION.format(k="user_id,")})
    union all select 'weekly_workouts', user_id, week_start, cast(session_count as double)
    from ({WEEKLY.format(k="user_id,")})
    union all select 'weekly_cardio', user_id, week_start, cast(total_km as double)
    from ({CARDIO.format(k="user_id,")})
    union all select 'weekly_sleep', user_id, week_start, cast(nights as double) from ({SLEEP})
    union all select 'weight_trend', user_id, measurement_date, cast(weight_lbs as double)
    from ({TREND.format(k="user_id,")})""",
)(
    lambda t: marts.publish_and_read(
        t,
        {
            "daily_nutrition": "total_calories", "weekly_workouts": "session_count",
            "weekly_cardio": "total_km", "weekly_sleep": "nights", "weight_trend": "weight_lbs",
        },
    )
)
