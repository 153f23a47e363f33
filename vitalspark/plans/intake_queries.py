"""Source and document queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.functions.dates import parse_scale_time
from vitalspark.operators.changes import insert_if_absent
from vitalspark.operators.strength import session_detail
from vitalspark.plans.catalog import query
from vitalspark.sources import documents, seeds
from vitalspark.sources.domain import AS_OF
from vitalspark.sources.scale import SCALE_COLUMNS, read_scale_measurements, reading_columns

query(
    "scan_table",
    "session_id:s exercise_id:n exercise_name:s set_number:n reps:n weight_lbs:f rpe:f notes:s"
    " gym_equipment_id:s",
    "workout_sets",
    "select * from workout_sets",
)(lambda t: seeds.conform(t["workout_sets"], "workout_sets"))


# ---- scale readings ----
def reading_lines(readings: DataFrame) -> DataFrame:
    """The readings as JSON text lines, the form in which they arrive."""
    skip = ("arrival", "renpho_user_id")
    fields = [
        F.col(c).alias("timeStamp" if c == "epoch_camel" else c) for c in readings.columns if c not in skip
    ]
    return readings.select(*skip, F.to_json(F.struct(*fields)).alias("value"))


def _sql_number(column: str) -> str:
    return f"try_cast(trim({column}) as decimal(20,6))"


def _sql_present(column: str) -> str:
    n = _sql_number(column)
    return f"coalesce(trim({column}) <> '' and ({n} is null or {n} <> 0), false)"


def _sql_value(field: str, kind: str, mass: bool) -> str:
    n = _sql_number(field)
    if mass:
        n = f"round({n} * cast(2.20462 as decimal(6,5)), 2)"
    if kind in ("int", "smallint"):
        n = f"trunc({n})"
    return f"case when {_sql_present(field)} then try_cast({n} as {kind}) end"


_FIRST = ", ".join(
    f"case when trim({c}) <> '' and trim({c}) not in ('0', '0.0') then trim({c}) end"
    for c in ("epoch_camel", "time_stamp", '"timestamp"')
)
SCALE_TIME = f"""coalesce(
    case when try_cast(coalesce({_FIRST}) as double) >= -62135596800
        and try_cast(coalesce({_FIRST}) as double) < 253402300800
      then make_timestamp(cast(try_cast(coalesce({_FIRST}) as double) * 1000000 as bigint)) end,
    try_strptime(localCreatedAt, '%Y-%m-%d %H:%M:%S'), timestamp '{AS_OF} 00:00:00')"""
_VALUES = ", ".join(f"{_sql_value(f, k, m)} as {c}" for f, (c, k, m) in SCALE_COLUMNS.items())
_PROBLEMS = ", ".join(
    f"case when {_sql_present(f)} and {c} is null then '{f}' end" for f, (c, _, _) in SCALE_COLUMNS.items()
)
MEASURED = f"""
select *, coalesce({_PROBLEMS}) as rejected_field, cast(measured_at as date) as measurement_date
from (select *, {SCALE_TIME} as measured_at, {_VALUES} from scale_readings)"""
MEASURED_COLUMNS = (
    "measured_at:t measurement_date:d weight_lbs:f body_fat_pct:f muscle_mass_lbs:f bone_mass_lbs:f"
    " body_water_pct:f visceral_fat:n bmi:f bmr_kcal:n metabolic_age:n"
)


def measured(t) -> DataFrame:
    lines = reading_lines(t["scale_readings"])
    return read_scale_measurements(reading_columns(lines), AS_OF, "arrival", "renpho_user_id")


query(
    "read_scale_measurements", f"arrival:n renpho_user_id:n {MEASURED_COLUMNS} rejected_field:s",
    "scale_readings", MEASURED,
)(measured)
query(
    "parse_scale_time", "arrival:n measured_at:t", "scale_readings",
    f"select arrival, {SCALE_TIME} as measured_at from scale_readings",
)(
    lambda t: t["scale_readings"].select(
        "arrival",
        parse_scale_time(
            [F.col("epoch_camel"), F.col("time_stamp"), F.col("timestamp")], F.col("localCreatedAt"), AS_OF
        ).alias("measured_at"),
    )
)


# ---- seeds on top of the stored library ----
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MACHINES = ", ".join(
    f"({i}, {', '.join(_quoted(x) for x in row)})" for i, row in enumerate(seeds.MACHINES, start=1)
)


def _seed_library(t) -> DataFrame:
    library = t["equipment_library"].select(
        F.col("id").cast("string").alias("id"), "name", "brand", "type", "category"
    )
    machines = seeds.load_seed_dims(t.spark)["equipment_library"].select(
        F.concat(F.lit("seed-"), "id").alias("id"), "name", "brand", "type", "category",
        F.col("id").cast("int").alias("arrival"),
    )
    once = insert_if_absent(library, machines, ["name", "brand"]).snapshot
    return insert_if_absent(once, machines, ["name", "brand"]).snapshot


query(
    "load_seed_dims", "id:s name:s brand:s type:s category:s", "equipment_library",
    f"""
    select cast(id as varchar) as id, name, brand, type, category from equipment_library
    union all
    select 'seed-' || cast(s.id as varchar), s.name, s.brand, s.type, s.category
    from (values {_MACHINES}) s(id, name, brand, type, category)
    where not exists (select 1 from equipment_library l where l.name = s.name and l.brand = s.brand)""",
)(_seed_library)


# ---- workout documents ----
def workout_documents(t) -> DataFrame:
    """The posts as JSON documents with nested exercises and sets."""
    key = F.col("session_id")

    def one_set(i, j):
        return F.struct(
            ((key + i + j) % 13).cast("int").alias("reps"),
            ((key * 7 + i * 3 + j) % 300).cast("decimal(6,2)").alias("weight_lbs"),
            F.when(j > 1, (F.lit(5) + j).cast("decimal(3,1)")).alias("rpe"),
            F.when(j == 1, F.lit("")).otherwise(F.lit("ok")).alias("notes"),
        )

    def up_to(n):
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    exercises = F.transform(
        up_to(F.col("entries")),
        lambda i: F.struct(
            F.concat(F.lit("exercise "), i.cast("string")).alias("name"),
            F.when(i == 1, F.lit("")).otherwise(F.concat(F.lit("m"), i.cast("string"))).alias("gym_equipment_id"),
            F.transform(up_to(F.col("sets_each")), lambda j: one_set(i, j)).alias("sets"),
        ),
    )
    document = F.struct("date", "name", "duration_min", exercises.alias("exercises"))
    return t["workout_posts"].select("session_id", "user_id", F.to_json(document).alias("value"))


_REASON = """case when date is null or date = '' then 'date is required'
  when name is null or name = '' then 'name is required' end"""
DOCUMENT_SETS = f"""
select p.session_id, i - 1 as exercise_position, 'exercise ' || i as exercise_name, j as set_number,
  nullif((session_id + i + j) % 13, 0) as reps, nullif((session_id * 7 + i * 3 + j) % 300, 0) as weight_lbs,
  case when j > 1 then 5 + j end as rpe, case when j > 1 then 'ok' end as notes,
  case when i > 1 then 'm' || i end as gym_equipment_id
from workout_posts p, unnest(generate_series(1, entries)) a(i), unnest(generate_series(1, sets_each)) b(j)
where {_REASON} is null"""


def _ingest(t):
    return documents.ingest_workout_documents(documents.parse_workout_json(workout_documents(t)))


query(
    "ingest_workout_documents",
    "session_id:n exercise_position:n exercise_name:s set_number:n reps:n weight_lbs:f rpe:f notes:s"
    " gym_equipment_id:s",
    "workout_posts", DOCUMENT_SETS,
)(lambda t: _ingest(t)[1])
query(
    "ingest_workout_sessions",
    "id:n user_id:n session_date:d name:s duration_min:n reason:s", "workout_posts",
    f"""select session_id as id, user_id, date as session_date, name,
          case when {_REASON} is null then nullif(duration_min, 0) else duration_min end as duration_min,
          {_REASON} as reason from workout_posts""",
)(
    lambda t: _ingest(t)[0].accepted.select(
        "id", "user_id", "session_date", "name", "duration_min", F.lit(None).cast("string").alias("reason")
    ).unionByName(
        _ingest(t)[0].rejected.select(
            F.col("session_id").alias("id"), "user_id", F.col("date").try_cast("date").alias("session_date"),
            "name", "duration_min", "reason",
        )
    )
)
query(
    "arrays_structs", "id:n exercises:n sets:n", "workout_sessions workout_sets",
    """select w.id, count(distinct s.exercise_name) as exercises, count(s.session_id) as sets
       from workout_sessions w left join workout_sets s on s.session_id = w.id group by w.id""",
)(
    lambda t: session_detail(t).groupBy("id").agg(
        F.sum(F.coalesce(F.size("exercises"), F.lit(0))).alias("exercises"),
        F.sum(
            F.coalesce(
                F.aggregate("exercises", F.lit(0), lambda n, e: n + F.size(e["sets"])), F.lit(0)
            )
        ).alias("sets"),
    )
)


# ---- nutrition entries ----
def nutrition_posts(t) -> DataFrame:
    """One JSON entry, or a list of two of which the second lacks its date."""
    def entry(day):
        return F.struct(
            day.alias("log_date"), "meal_type", "food_name", "calories_kcal",
            (F.col("id") % 3).cast("decimal(6,2)").alias("protein_g"),
            F.col("carbs_g"), F.col("fat_g"), F.lit("").alias("notes"),
        )

    day = F.col("log_date").cast("string")
    single = F.to_json(entry(day))
    double = F.to_json(F.array(entry(day), entry(F.lit(None).cast("string"))))
    return t["nutrition_log"].select(
        "id", "user_id", F.when(F.col("meal_type") == "Snack", double).otherwise(single).alias("value")
    )


_ENTRY = """select id, user_id, {pos} as entry_position, {day} as log_date, meal_type, food_name,
  {kcal} as calories_kcal, {protein} as protein_g, {carbs} as carbs_g, {fat} as fat_g, {reason} as reason
  from nutrition_log"""
query(
    "ingest_nutrition_entries",
    "id:n user_id:n entry_position:n log_date:d meal_type:s food_name:s calories_kcal:n protein_g:f"
    " carbs_g:f fat_g:f reason:s",
    "nutrition_log",
    _ENTRY.format(
        pos=0, day="log_date", kcal="nullif(calories_kcal, 0)", protein="nullif(id % 3, 0)",
        carbs="nullif(carbs_g, 0)", fat="nullif(fat_g, 0)", reason="null",
    ) + " union all " + _ENTRY.format(
        pos=1, day="null", kcal="calories_kcal", protein="id % 3", carbs="carbs_g", fat="fat_g",
        reason="'log_date is required'",
    ) + " where meal_type = 'Snack'",
)(
    lambda t: documents.ingest_nutrition_entries(nutrition_posts(t)).accepted.drop("notes")
    .withColumn("reason", F.lit(None).cast("string"))
    .unionByName(
        documents.ingest_nutrition_entries(nutrition_posts(t)).rejected.drop("notes")
        .withColumn("log_date", F.col("log_date").try_cast("date"))
    )
)


# ---- rows with defaults ----
def _cardio_posts(t) -> DataFrame:
    return t["cardio_sessions"].select(
        "id", "user_id", F.when(F.col("steps").isNotNull(), F.col("session_date")).alias("session_date"),
        F.when(F.col("activity_type") == "Walk", F.lit("")).otherwise(F.col("activity_type")).alias("activity_type"),
        (F.col("id") % 3).cast("int").alias("duration_min"), "distance_km", F.lit("").alias("notes"),
    )


query(
    "ingest_with_defaults",
    "kind:s id:n activity:s minutes:n distance_km:f reason:s",
    "cardio_sessions body_metrics gyms",
    """
    select 'cardio' as kind, id, case when activity_type = 'Walk' then 'Other' else activity_type end as activity,
      nullif(id % 3, 0) as minutes, nullif(distance_km, 0) as distance_km,
      case when steps is null then 'session_date is required' end as reason from cardio_sessions
    union all select 'metric', id, case when source = 'renpho' then source else 'manual' end, null,
      nullif(coalesce(weight_lbs, 0), 0), null from body_metrics
    union all select 'gym', id, case when gym_type = 'Independent' then gym_type else 'Commercial chain' end,
      null, null, case when state = 'ASIA' then 'name is required' end from gyms""",
)(
    lambda t: _both(documents.ingest_cardio(_cardio_posts(t))).select(
        F.lit("cardio").alias("kind"), "id", F.col("activity_type").alias("activity"),
        F.col("duration_min").alias("minutes"), "distance_km", "reason",
    ).unionByName(
        documents.ingest_metrics(
            t["body_metrics"].select(
                "id", F.coalesce("weight_lbs", F.lit(0).cast("decimal(6,2)")).alias("weight_lbs"),
                F.when(F.col("source") == "renpho", F.col("source")).otherwise("").alias("source"), "measured_at",
            ), AS_OF,
        ).select(
            F.lit("metric").alias("kind"), "id", F.col("source").alias("activity"),
            F.lit(None).cast("int").alias("minutes"), F.col("weight_lbs").alias("distance_km"),
            F.lit(None).cast("string").alias("reason"),
        )
    ).unionByName(
        _both(documents.ingest_gyms(
            t["gyms"].select(
                "id", F.when(F.col("state") == "ASIA", "").otherwise(F.col("name")).alias("name"),
                F.when(F.col("gym_type") == "Independent", F.col("gym_type")).alias("gym_type"),
                "is_24hr", "is_default", "city",
            )
        )).select(
            F.lit("gym").alias("kind"), "id", F.col("gym_type").alias("activity"),
            F.lit(None).cast("int").alias("minutes"), F.lit(None).cast("decimal(7,2)").alias("distance_km"),
            "reason",
        )
    )
)


def _both(split) -> DataFrame:
    """Accepted and rejected rows in one table."""
    return split.accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(split.rejected)
