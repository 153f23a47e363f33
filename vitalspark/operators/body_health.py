"""Body measurements and wearable vitals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.functions.dates import days_before, week_start
from vitalspark.functions.health import bp_class
from vitalspark.functions.numbers import mean_rounded, metres_to_km
from vitalspark.functions.text import pace_text
from vitalspark.operators.strength import valid_weight
from vitalspark.skew import first_rows, rolling_rows

Tables = Mapping[str, DataFrame]
USER = ("user_id",)


def weekly_sleep(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Nights and means per Monday week."""
    return (
        t["sleep_sessions"]
        .groupBy(*keys, week_start(F.col("session_date")).alias("week_start"))
        .agg(
            F.count(F.lit(1)).alias("nights"),
            mean_rounded(F.col("duration_min"), 0).alias("avg_sleep_min"),
            mean_rounded(F.col("deep_min"), 0).alias("avg_deep_min"),
            mean_rounded(F.col("rem_min"), 0).alias("avg_rem_min"),
            mean_rounded(F.col("efficiency_pct"), 1).alias("avg_efficiency"),
            mean_rounded(F.col("sleep_score"), 1).alias("avg_sleep_score"),
        )
    )


def _daily_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys, "measurement_date").agg(mean_rounded(F.col(value), 1).alias(name))


def daily_spo2(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    return _daily_mean(t["blood_oxygen"], keys, "spo2_pct", "avg_spo2")


def daily_stress(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    return _daily_mean(t["stress_readings"], keys, "stress_score", "avg_stress")


def weight_trend(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """One weigh-in per day: the last stored, an unknown store time counting as last."""
    newest = [F.col("created_at").desc_nulls_first(), F.col("id").desc()]
    return first_rows(
        valid_weight(t["body_metrics"]), [*keys, "measurement_date"], newest
    ).select(
        *keys, "measurement_date", "weight_lbs", "body_fat_pct", "muscle_mass_lbs", "bmi", "source"
    )


def weight_series(t: Tables, as_of, *, keys: Sequence[str] = USER, days: int = 30) -> DataFrame:
    """All weigh-ins of the trailing days."""
    recent = F.col("measurement_date") >= days_before(as_of, days)
    return valid_weight(t["body_metrics"]).filter(recent).select(
        *keys, F.col("measurement_date").alias("date"), "weight_lbs"
    )


def latest_metric(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Newest measurement with a weight, whole row."""
    newest = [F.col("measured_at").desc(), F.col("id").desc()]
    return first_rows(valid_weight(t["body_metrics"]), keys, newest)


def last_bp_per_day(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    newest = [F.col("measured_at").desc(), F.col("id").desc()]
    return first_rows(t["blood_pressure"], [*keys, "measurement_date"], newest).select(
        *keys, "measurement_date", "systolic_mmhg", "diastolic_mmhg"
    )


def one_sleep_per_night(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """The sleep that ended last on each night's date."""
    newest = [F.col("sleep_end").desc(), F.col("id").desc()]
    return first_rows(t["sleep_sessions"], [*keys, "session_date"], newest).select(
        *keys, "session_date", "duration_min", "deep_min", "rem_min", "light_min",
        "efficiency_pct", "sleep_score",
    )


def hr_trend(t: Tables, *, keys: Sequence[str] = USER, rows: int = 7) -> DataFrame:
    """Resting heart rate with its mean over the last readings (not days).

    A user has one row a day, so with a user key one window over the user's readings does.
    ``keys=()`` gives one series over all rows; it is cut into blocks, sliced by day and reading.
    """
    readings = t["heart_rate_daily"].filter(F.col("resting_bpm").isNotNull())
    readings = readings.select(*keys, "summary_date", "resting_bpm", "hrv_ms")
    order = [F.col("summary_date"), F.col("resting_bpm"), F.col("hrv_ms")]

    def mean(window) -> Column:
        return F.round(F.avg(F.col("resting_bpm").cast("decimal(20,12)")).over(window), 1)

    if keys:
        known = readings.dropna(subset=[*keys, "summary_date"])
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
        shown = known.withColumn("rolling_7day_avg", mean(window))
    else:
        shown = rolling_rows(
            readings, keys, F.struct("summary_date", "resting_bpm"), order, rows, mean,
            "rolling_7day_avg", null_groups=False,
        )
    return shown.select(*keys, "summary_date", "resting_bpm", "rolling_7day_avg", "hrv_ms")


def blood_pressure_log(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    return t["blood_pressure"].select(
        *keys, "measured_at", "measurement_date", "systolic_mmhg", "diastolic_mmhg", "pulse_bpm",
        bp_class(F.col("systolic_mmhg"), F.col("diastolic_mmhg")).alias("classification"),
        "source", "notes",
    )


def samsung_workout_history(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    return t["samsung_workouts"].select(
        *keys, "session_date", "activity_type", "duration_min",
        metres_to_km(F.col("distance_m")).alias("distance_km"),
        "calories", "avg_hr_bpm", "max_hr_bpm",
        pace_text(F.col("avg_pace_sec_km")).alias("avg_pace"),
        "avg_speed_kmh", "elevation_gain_m", "vo2_max", "workout_score", "source",
    )


ACTIVITY = ("steps", "distance_m", "calories_active", "calories_total", "active_min", "floors_climbed", "vo2_max")
HEART = ("resting_bpm", "min_bpm", "max_bpm", "hrv_ms")
PRESSURE = ("systolic_mmhg", "diastolic_mmhg")
SLEEP = ("duration_min", "deep_min", "rem_min", "light_min", "efficiency_pct", "sleep_score")
SOURCES = ("activity", "heart", "pressure", "oxygen", "stress", "sleep")


def _piece(df: DataFrame, keys: Sequence[str], day: Column, source: str, *columns) -> DataFrame:
    return df.select(*keys, day.alias("_day"), F.lit(source).alias("_source"), *columns)


def daily_health_summary(
    t: Tables, *, keys: Sequence[str] = USER, mode: str = "strict"
) -> DataFrame:
    """All daily sources side by side; sleep counts for the day after its date.

    The six sources are stacked and reduced in one aggregation per (keys, day): one
    shuffle instead of a chain of five full joins, and no pile of null join keys.

    ``aligned``: one row per (keys, day). ``strict``: only a day with an activity row
    brings the sources together; on other days each source has a row of its own, and
    the date is shown for heart rate and blood pressure only. Activity and heart
    summaries hold one row per (keys, day), as their unique rules say.
    """
    if mode not in ("strict", "aligned"):
        raise ValueError("mode is strict or aligned")
    pressure = F.struct("measured_at", "id", *PRESSURE).alias("_pressure")
    sleep = F.struct("sleep_end", "id", *SLEEP).alias("_sleep")
    stacked = reduce(
        partial(DataFrame.unionByName, allowMissingColumns=True),
        [
            _piece(t["daily_activity"], keys, F.col("activity_date"), "activity", *ACTIVITY),
            _piece(t["heart_rate_daily"], keys, F.col("summary_date"), "heart", *HEART),
            _piece(t["blood_pressure"], keys, F.col("measurement_date"), "pressure", pressure),
            _piece(t["blood_oxygen"], keys, F.col("measurement_date"), "oxygen", "spo2_pct"),
            _piece(t["stress_readings"], keys, F.col("measurement_date"), "stress", "stress_score"),
            _piece(t["sleep_sessions"], keys, F.date_add("session_date", 1), "sleep", sleep),
        ],
    )
    days = stacked.groupBy(*keys, "_day").agg(
        *[F.max(F.col("_source") == s).alias(f"_has_{s}") for s in SOURCES],
        *[F.max(c).alias(c) for c in (*ACTIVITY, *HEART)],
        F.max("_pressure").alias("_pressure"),
        mean_rounded(F.col("spo2_pct"), 1).alias("avg_spo2"),
        mean_rounded(F.col("stress_score"), 1).alias("avg_stress"),
        F.max("_sleep").alias("_sleep"),
    )
    values = {
        "steps": (F.col("steps"), "activity"),
        "distance_km": (metres_to_km(F.col("distance_m")), "activity"),
        "calories_active": (F.col("calories_active"), "activity"),
        "calories_total": (F.col("calories_total"), "activity"),
        "active_min": (F.col("active_min"), "activity"),
        "floors_climbed": (F.col("floors_climbed"), "activity"),
        "vo2_max_daily": (F.col("vo2_max"), "activity"),
        **{c: (F.col(c), "heart") for c in HEART},
        **{c: (F.col(f"_pressure.{c}"), "pressure") for c in PRESSURE},
        "avg_spo2": (F.col("avg_spo2"), "oxygen"),
        "avg_stress": (F.col("avg_stress"), "stress"),
        "sleep_min": (F.col("_sleep.duration_min"), "sleep"),
        "deep_min": (F.col("_sleep.deep_min"), "sleep"),
        "rem_min": (F.col("_sleep.rem_min"), "sleep"),
        "light_min": (F.col("_sleep.light_min"), "sleep"),
        "sleep_efficiency": (F.col("_sleep.efficiency_pct"), "sleep"),
        "sleep_score": (F.col("_sleep.sleep_score"), "sleep"),
    }
    if mode == "aligned":
        return days.select(
            *keys, F.col("_day").alias("summary_date"), *[v.alias(n) for n, (v, _) in values.items()]
        )
    alone = F.array_compact(
        F.array(*[F.when(F.col(f"_has_{s}"), F.lit(s)) for s in SOURCES[1:]])
    )
    rows = days.withColumn(
        "_shows", F.explode(F.when(F.col("_has_activity"), F.array(F.lit("all"))).otherwise(alone))
    )
    dated = F.col("_shows").isin("all", "heart", "pressure")
    return rows.select(
        *keys,
        F.when(dated, F.col("_day")).alias("summary_date"),
        *[
            F.when(F.col("_shows").isin("all", source), v).alias(n)
            for n, (v, source) in values.items()
        ],
    )
