"""Streams run to the end of the available input, then read back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.plans.catalog import query
from vitalspark.plans.health_queries import CARDIO, NUTRITION, NUTRITION_COLUMNS, SLEEP
from vitalspark.plans.intake_queries import MEASURED, MEASURED_COLUMNS, reading_lines
from vitalspark.plans.strength_queries import WEEK_COLUMNS, WEEKLY
from vitalspark.session import work_dir
from vitalspark.sources.domain import AS_OF, TABLE_SQL
from vitalspark.streaming import flags, oos, periods, scale
from vitalspark.streaming.store import finish


def stream_table(t, name: str, source: str) -> DataFrame:
    """A model table over a general table that is read as a stream of files."""
    path = f"{t.sf_dir.rstrip('/')}/{source}.parquet*"
    schema = t.raw(source).schema
    view = f"_stream_{source}"
    t.spark.readStream.schema(schema).parquet(path).createOrReplaceTempView(view)
    if name == source:
        return t.spark.table(view)
    return t.spark.sql(TABLE_SQL[name].format(**{source: view}))


def _folders(t, purpose: str) -> tuple[str, str]:
    root = work_dir(t.spark, purpose)
    return f"{root}/store", f"{root}/checkpoint"


@query(
    "stream_scale_measurements",
    f"renpho_user_id:n arrival:n {MEASURED_COLUMNS}",
    "scale_readings",
    f"""select * from (select *, row_number() over (partition by renpho_user_id, measured_at order by arrival) as place
        from ({MEASURED}) where rejected_field is null) where place = 1""",
)
def _scale(t):
    store, checkpoint = _folders(t, "scale")
    lines = reading_lines(stream_table(t, "scale_readings", "events"))
    finish(scale.stream_scale_measurements(lines, store, checkpoint, AS_OF))
    return scale.loaded_measurements(t.spark, store)


@query(
    "stream_scale_bounded", f"renpho_user_id:n arrival:n {MEASURED_COLUMNS}", "scale_readings",
    f"""select * from (select *, row_number() over (partition by renpho_user_id, measured_at order by arrival) as place
        from ({MEASURED}) where rejected_field is null) where place = 1 or renpho_user_id is null""",
)
def _scale_bounded(t):
    store, checkpoint = _folders(t, "scale-bounded")
    lines = reading_lines(stream_table(t, "scale_readings", "events"))
    finish(scale.stream_scale_bounded(lines, store, checkpoint, AS_OF))
    return scale.loaded_measurements(t.spark, store)


HOLD_DAYS, DELAY_DAYS = 5, 1
OOS_EVENTS = """
select user_id as gym_equipment_id, ts as moment, case when event_type = 'error' then 'report' else 'resolve' end as kind
from events where event_type in ('error', 'signup')"""


@query(
    "stream_oos_state",
    "gym_equipment_id:n is_out_of_service:b cause:s",
    "",
    f"""
    with e as ({OOS_EVENTS}),
    newest as (select gym_equipment_id, max(moment) as moment, max_by(kind, moment) as kind from e group by 1),
    mark as (select max(moment) - interval {DELAY_DAYS} day as moment from e),
    due as (select n.*, date_trunc('milliseconds', n.moment) + interval {HOLD_DAYS} day <= mark.moment as passed
      from newest n, mark)
    select gym_equipment_id, kind = 'report' and not passed as is_out_of_service,
      case when kind = 'report' and passed then 'cleared' else kind end as cause
    from due""",
)
def _oos(t):
    store, checkpoint = _folders(t, "oos")
    events = stream_table(t, "events", "events").select(
        F.col("user_id").alias("gym_equipment_id"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "error", "report").when(F.col("event_type") == "signup", "resolve")
        .otherwise(F.col("event_type")).alias("kind"),
    )
    finish(oos.stream_oos_state(events, store, checkpoint, days=HOLD_DAYS, delay=f"{DELAY_DAYS} days"))
    return oos.machine_status(t.spark, store)


@query(
    "stream_flag_threshold", "id:n name:s flag_count:n is_flagged:b",
    "equipment_library equipment_flags",
    """select l.id, l.name, l.flag_count + coalesce(f.n, 0) as flag_count,
         l.is_flagged or (f.n is not null and l.flag_count + f.n >= 3) as is_flagged
       from equipment_library l left join (select target_id, count(*) as n from equipment_flags
         where target_type = 'library' group by 1) f on f.target_id = l.id""",
)
def _flags(t):
    store, checkpoint = _folders(t, "flags")
    finish(flags.stream_flag_threshold(stream_table(t, "equipment_flags", "events"), store, checkpoint))
    return flags.set_flag_counts(
        t["equipment_library"], flags.flag_totals(t.spark, store), "library"
    )


def _periods(t, spec, table: str, source: str) -> DataFrame:
    store, checkpoint = _folders(t, spec.name)
    rows = stream_table(t, table, source)
    finish(periods.stream_period_totals(rows, spec, store, checkpoint))
    return periods.period_totals(t.spark, store, spec)


query("stream_daily_weekly", f"user_id:n {NUTRITION_COLUMNS}", "nutrition_log", NUTRITION.format(k="user_id,"))(
    lambda t: _periods(t, periods.daily_nutrition(), "nutrition_log", "events")
)
query("stream_weekly_workouts", f"user_id:n {WEEK_COLUMNS}", "workout_sessions", WEEKLY.format(k="user_id,"))(
    lambda t: _periods(t, periods.weekly_workouts(), "workout_sessions", "orders")
)
query(
    "stream_weekly_cardio",
    "user_id:n week_start:d activity_type:s session_count:n total_km:f total_min:n total_steps:n",
    "cardio_sessions", CARDIO.format(k="user_id,"),
)(lambda t: _periods(t, periods.weekly_cardio(), "cardio_sessions", "events"))
query(
    "stream_weekly_sleep",
    "user_id:n week_start:d nights:n avg_sleep_min:f avg_deep_min:f avg_rem_min:f"
    " avg_efficiency:f avg_sleep_score:f",
    "sleep_sessions", SLEEP,
)(lambda t: _periods(t, periods.weekly_sleep(), "sleep_sessions", "events"))
