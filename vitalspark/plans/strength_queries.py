"""Lifting queries."""

from pyspark.sql import functions as F

from vitalspark.operators import history, strength
from vitalspark.plans.catalog import query
from vitalspark.sources.domain import AS_OF

SETS = "workout_sessions workout_sets"
MACHINES = "gym_equipment equipment_library gyms"

JOINED = """
select w.user_id, w.id as session_id, w.session_date, w.name as workout_name, s.set_number,
  s.exercise_name, s.reps, s.weight_lbs, s.rpe, s.gym_equipment_id, s.exercise_id
from workout_sets s join workout_sessions w on w.id = s.session_id"""
NAMED = f"""
select j.*, el.name as equipment_name, el.brand as equipment_brand, el.type as equipment_type,
  g.name as gym_name
from ({JOINED}) j left join gym_equipment ge on ge.id = j.gym_equipment_id
left join equipment_library el on el.id = ge.equipment_id left join gyms g on g.id = ge.gym_id"""

query(
    "sets_with_machine",
    "user_id:n session_id:n session_date:d workout_name:s set_number:n exercise_name:s reps:n"
    " weight_lbs:f gym_equipment_id:n equipment_name:s equipment_brand:s equipment_type:s gym_name:s",
    f"{SETS} {MACHINES}",
    NAMED,
)(strength.sets_with_machine)

DETAIL = f"""
select j.user_id, j.session_date, j.workout_name as session_name, w.duration_min, j.set_number,
  coalesce(e.name, j.exercise_name) as exercise, m.name as muscle_group, j.weight_lbs, j.reps, j.rpe
from ({JOINED}) j join workout_sessions w on w.id = j.session_id
left join exercises e on e.id = j.exercise_id left join muscle_groups m on m.id = e.muscle_group_id"""
DETAIL_TABLES = f"{SETS} exercises muscle_groups"

query(
    "workout_detail",
    "user_id:n session_date:d session_name:s duration_min:n set_number:n exercise:s"
    " muscle_group:s weight_lbs:f reps:n rpe:f",
    DETAIL_TABLES,
    DETAIL,
)(strength.workout_detail)

PRS = """
select {k} exercise, muscle_group, max(weight_lbs) as pr_weight_lbs, max(reps) as max_reps,
  max(session_date) as last_performed
from ({detail}) group by {k} exercise, muscle_group"""
query(
    "exercise_prs",
    "user_id:n exercise:s muscle_group:s pr_weight_lbs:f max_reps:n last_performed:d",
    DETAIL_TABLES,
    PRS.format(k="user_id,", detail=DETAIL),
)(strength.exercise_prs)
query(
    "exercise_prs_all_users",
    "exercise:s muscle_group:s pr_weight_lbs:f max_reps:n last_performed:d",
    DETAIL_TABLES,
    PRS.format(k="", detail=DETAIL),
)(lambda t: strength.exercise_prs(t, keys=()))

query(
    "exercise_catalog", "id:n name:s equipment:s is_custom:b muscle_group:s",
    "exercises muscle_groups",
    """select e.id, e.name, e.equipment, e.is_custom, m.name as muscle_group
       from exercises e left join muscle_groups m on m.id = e.muscle_group_id""",
)(strength.exercise_catalog)

RECORDS = f"""
select r.user_id, r.exercise_name, r.equipment_name, r.equipment_brand, r.equipment_type, r.gym_name,
  r.max_weight_lbs, r.estimated_1rm, top.reps as reps_at_max, r.session_count, r.total_sets,
  r.last_performed, r.first_performed
from (
  select user_id, exercise_name, equipment_name, equipment_brand, equipment_type, gym_name,
    max(weight_lbs) as max_weight_lbs,
    round(max(case when reps is not null
      then weight_lbs * (1 + cast(0.0333 as decimal(4,4)) * cast(reps as decimal(5,0))) end), 2) as estimated_1rm,
    count(distinct session_date) as session_count, count(*) as total_sets,
    cast(max(session_date) as varchar) as last_performed,
    cast(min(session_date) as varchar) as first_performed
  from ({NAMED}) where weight_lbs > 0
  group by user_id, exercise_name, equipment_name, equipment_brand, equipment_type, gym_name
) r left join (
  select user_id, lower(exercise_name) as exercise_key, weight_lbs, reps,
    row_number() over (partition by user_id, lower(exercise_name), weight_lbs
      order by session_date desc, session_id desc, set_number desc, reps desc nulls last) as place
  from ({JOINED}) where weight_lbs > 0
) top on top.user_id = r.user_id and top.exercise_key = lower(r.exercise_name)
  and top.weight_lbs = r.max_weight_lbs and top.place = 1"""
RECORD_KEY = (
    "user_id:n exercise_name:s equipment_name:s equipment_brand:s equipment_type:s gym_name:s"
)
RECORD_TABLES = f"{SETS} {MACHINES}"
query(
    "personal_records",
    f"{RECORD_KEY} max_weight_lbs:f estimated_1rm:f reps_at_max:n session_count:n total_sets:n"
    " last_performed:s first_performed:s",
    RECORD_TABLES,
    RECORDS,
)(strength.personal_records)
for part, columns in {
    "estimated_1rm": "estimated_1rm:f",
    "reps_at_max": "max_weight_lbs:f reps_at_max:n",
    "session_count": "session_count:n",
    "total_sets": "total_sets:n",
    "first_last_performed": "first_performed:s last_performed:s",
}.items():
    query(part, f"{RECORD_KEY} {columns}", RECORD_TABLES, RECORDS)(strength.personal_records)
query(
    "prs_by_machine",
    f"{RECORD_KEY} max_weight_lbs:f estimated_1rm:f reps_at_max:n session_count:n total_sets:n"
    " last_performed:s first_performed:s",
    RECORD_TABLES,
    f"select * from ({RECORDS}) where gym_name is not null or equipment_name is not null",
)(strength.prs_by_machine)

query(
    "valid_weight", "session_id:n set_number:n exercise_name:s weight_lbs:f",
    "workout_sets",
    "select * from workout_sets where weight_lbs is not null and weight_lbs > 0",
)(lambda t: strength.valid_weight(t["workout_sets"], positive=True))

BUSY_MACHINE = 100000519
query(
    "optional_equipment_filter", "session_id:n set_number:n exercise_name:s gym_equipment_id:n",
    "workout_sets",
    f"""select * from workout_sets
        union all select * from workout_sets where gym_equipment_id = {BUSY_MACHINE}""",
)(
    lambda t: strength.optional_equipment_filter(t["workout_sets"]).unionByName(
        strength.optional_equipment_filter(t["workout_sets"], BUSY_MACHINE)
    )
)

LAST = """
select {k}, session_id, session_date, workout_name, equipment_name, equipment_brand, gym_name,
  set_number, reps, weight_lbs, rpe
from (
  select n.*, lower(exercise_name) as exercise_key,
    max(session_date) over (partition by user_id, lower(exercise_name){machine}) as newest
  from ({named}) n where {where}
) where session_date = newest"""
GENERAL = LAST.format(k="user_id, exercise_key", machine="", named=NAMED, where="true")
SPECIAL = LAST.format(
    k="user_id, exercise_key, gym_equipment_id", machine=", gym_equipment_id", named=NAMED,
    where="gym_equipment_id is not null",
)
SET_COLUMNS = "set_number:n reps:n weight_lbs:f rpe:f"
HEADER_COLUMNS = "session_date:d workout_name:s equipment_name:s equipment_brand:s gym_name:s"


def _nested_again(nested, *keys):
    return nested.select(*keys, *strength.HEADER, F.explode("sets").alias("_s")).select(
        *keys, *strength.HEADER, "_s.*"
    )


# Nested documents, checked one set per row with the header of each document.
query(
    "last_performance",
    f"user_id:n exercise_key:s {HEADER_COLUMNS} {SET_COLUMNS}",
    f"{SETS} {MACHINES}",
    f"""
    select g.user_id, g.exercise_key, h.session_date, h.workout_name, h.equipment_name,
      h.equipment_brand, h.gym_name, g.set_number, g.reps, g.weight_lbs, g.rpe
    from ({GENERAL}) g join (
      select *, row_number() over (partition by user_id, exercise_key
        order by set_number, session_id, reps nulls first, weight_lbs nulls first, rpe nulls first,
          gym_equipment_id nulls first) as place
      from ({LAST.format(k="user_id, exercise_key, gym_equipment_id", machine="", named=NAMED, where="true")})
    ) h on h.user_id = g.user_id and h.exercise_key = g.exercise_key and h.place = 1""",
)(lambda t: _nested_again(strength.last_performance(t), "user_id", "exercise_key"))
query(
    "last_performance_by_machine",
    f"user_id:n exercise_key:s gym_equipment_id:n session_id:n {HEADER_COLUMNS} {SET_COLUMNS}",
    f"{SETS} {MACHINES}",
    SPECIAL,
)(lambda t: strength.last_performance_rows(t, per_machine=True))

REQUESTS = f"""
select distinct user_id, lower(exercise_name) as exercise_key,
  case when rpe > 7 then 1 else gym_equipment_id end as requested_machine
from ({JOINED})"""


def _fallback(t):
    machine = F.when(F.col("rpe") > 7, F.lit(1)).otherwise(F.col("gym_equipment_id"))
    return strength.last_performance_fallback(t, machine)


query(
    "last_performance_fallback",
    f"user_id:n exercise_key:s requested_machine:n used_machine:b session_id:n {HEADER_COLUMNS} {SET_COLUMNS}",
    f"{SETS} {MACHINES}",
    f"""
    with asked as ({REQUESTS}), special as ({SPECIAL}), general as ({GENERAL})
    select a.user_id, a.exercise_key, a.requested_machine, true as used_machine,
      s.session_id, s.session_date, s.workout_name, s.equipment_name, s.equipment_brand, s.gym_name,
      s.set_number, s.reps, s.weight_lbs, s.rpe
    from asked a join special s on s.user_id = a.user_id and s.exercise_key = a.exercise_key
      and s.gym_equipment_id = a.requested_machine
    union all
    select a.user_id, a.exercise_key, a.requested_machine, false,
      g.session_id, g.session_date, g.workout_name, g.equipment_name, g.equipment_brand, g.gym_name,
      g.set_number, g.reps, g.weight_lbs, g.rpe
    from asked a join general g on g.user_id = a.user_id and g.exercise_key = a.exercise_key
    where not exists (select 1 from special s where s.user_id = a.user_id
      and s.exercise_key = a.exercise_key and s.gym_equipment_id = a.requested_machine)""",
)(_fallback)

LISTED = """
select w.id, w.user_id, w.session_date, w.name, w.duration_min, w.notes, w.created_at, w.gym_id,
  g.name as gym_name, coalesce(c.n, 0) as exercise_count,
  row_number() over (partition by w.user_id
    order by w.session_date desc, w.created_at desc nulls first, w.id desc) as place
from workout_sessions w left join gyms g on g.id = w.gym_id left join (
  select session_id, count(distinct exercise_name) as n from workout_sets group by session_id
) c on c.session_id = w.id"""
LIST_COLUMNS = (
    "user_id:n id:n session_date:d name:s duration_min:n notes:s created_at:t gym_id:n"
    " gym_name:s exercise_count:n"
)
query("session_list", LIST_COLUMNS, f"{SETS} gyms", f"select * from ({LISTED}) where place <= 50")(
    lambda t: strength.session_list(t, limit=50)
)
query("session_list_all", LIST_COLUMNS, f"{SETS} gyms", LISTED)(
    lambda t: strength.session_list(t, limit=None)
)

query(
    "session_detail",
    "id:n user_id:n session_date:d name:s exercise_name:s place:n reps:n weight_lbs:f rpe:f notes:s",
    SETS,
    """
    select w.id, w.user_id, w.session_date, w.name, s.exercise_name, s.reps, s.weight_lbs, s.rpe, s.notes,
      row_number() over (partition by s.session_id, s.exercise_name order by s.set_number,
        s.reps nulls first, s.weight_lbs nulls first, s.rpe nulls first, s.notes nulls first) as place
    from workout_sessions w join workout_sets s on s.session_id = w.id""",
)(
    lambda t: strength.session_detail_rows(
        strength.session_detail(t), "id", "user_id", "session_date", "name"
    )
)

query(
    "paged_history", "user_id:n id:n measurement_date:d measured_at:t weight_lbs:f",
    "body_metrics",
    """select * from (select *, row_number() over (partition by user_id
         order by measurement_date desc, measured_at desc, id desc) as place from body_metrics)
       where place between 11 and 50""",
)(lambda t: history.metrics_page(t["body_metrics"], limit=40, offset=10))
query(
    "paged_history_deep", "user_id:n id:n session_date:d activity_type:s distance_km:f",
    "cardio_sessions",
    """select * from (select *, row_number() over (partition by activity_type
         order by session_date desc, created_at desc, id desc) as place from cardio_sessions)
       where place between 501 and 1500""",
)(
    lambda t: history.page_rows(
        t["cardio_sessions"], ["activity_type"], "session_date",
        [F.col("session_date").desc(), F.col("created_at").desc(), F.col("id").desc()],
        limit=1000, offset=500,
    )
)
query(
    "paged_cardio", "user_id:n id:n session_date:d activity_type:s distance_km:f",
    "cardio_sessions",
    """select * from (select *, row_number() over (partition by user_id
         order by session_date desc, created_at desc, id desc) as place from cardio_sessions)
       where place <= 50""",
)(lambda t: history.cardio_page(t["cardio_sessions"]))
query(
    "filter_nutrition_day", "user_id:n id:n log_date:d meal_type:s calories_kcal:n",
    "nutrition_log",
    "select * from nutrition_log where log_date = date '2024-01-15'",
)(lambda t: history.nutrition_page(t["nutrition_log"], day="2024-01-15"))

WEEKLY = """
select {k} cast(date_trunc('week', session_date) as date) as week_start, count(*) as session_count,
  sum(duration_min) as total_duration_min,
  case when count(duration_min) > 0 then ((20 * cast(sum(duration_min) as bigint) + count(duration_min))
    // (2 * count(duration_min))) / 10.0 end as avg_duration_min
from workout_sessions group by {k} cast(date_trunc('week', session_date) as date)"""
WEEK_COLUMNS = "week_start:d session_count:n total_duration_min:n avg_duration_min:f"
query("weekly_workouts", f"user_id:n {WEEK_COLUMNS}", "workout_sessions", WEEKLY.format(k="user_id,"))(
    strength.weekly_workouts
)
query("weekly_workouts_all_users", WEEK_COLUMNS, "workout_sessions", WEEKLY.format(k=""))(
    lambda t: strength.weekly_workouts(t, keys=())
)

VOLUME = """
select w.user_id, w.session_date as date,
  floor(coalesce(sum(s.weight_lbs * s.reps), 0) + 0.5) as total_lbs
from workout_sessions w left join workout_sets s on s.session_id = w.id
{where} group by w.user_id, w.session_date"""
query("volume_by_day", "user_id:n date:d total_lbs:n", SETS, VOLUME.format(where=""))(
    strength.volume_by_day
)
query(
    "volume_by_day_recent", "user_id:n date:d total_lbs:n", SETS,
    VOLUME.format(where=f"where w.session_date >= date '{AS_OF}' - 7"),
)(lambda t: strength.volume_by_day(t, as_of=AS_OF))
