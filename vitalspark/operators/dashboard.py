"""The activity feed and the per-user summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.functions.dates import as_date
from vitalspark.functions.numbers import km_to_miles
from vitalspark.operators.body_health import latest_metric
from vitalspark.operators.cardio_nutrition import filter_since
from vitalspark.operators.strength import valid_weight
from vitalspark.skew import first_rows

Tables = Mapping[str, DataFrame]
USER = ("user_id",)


def _suffix(value, unit: str):
    return F.coalesce(F.concat(F.lit(" · "), value.cast("string"), F.lit(unit)), F.lit(""))


def activity_feed(t: Tables, *, keys: Sequence[str] = USER, top: int | None = 10) -> DataFrame:
    """Workouts, cardio and weigh-ins as dated text, the newest ``top`` per user or all."""
    workouts = t["workout_sessions"].select(
        *keys, F.col("session_date").alias("date"), F.lit("Workout").alias("type"),
        F.concat("name", _suffix(F.col("duration_min"), "min")).alias("detail"), "id",
    )
    cardio = t["cardio_sessions"].select(
        *keys, F.col("session_date").alias("date"), F.lit("Cardio").alias("type"),
        F.concat("activity_type", _suffix(km_to_miles(F.col("distance_km")), "mi")).alias("detail"),
        "id",
    )
    weigh_ins = valid_weight(t["body_metrics"]).select(
        *keys, F.col("measurement_date").alias("date"), F.lit("Weight").alias("type"),
        F.concat(
            F.col("weight_lbs").cast("string"), F.lit(" lbs"),
            _suffix(F.col("body_fat_pct"), "% BF"),
        ).alias("detail"),
        "id",
    )
    feed = workouts.unionByName(cardio).unionByName(weigh_ins)
    if top is not None:
        feed = first_rows(feed, keys, [F.col("date").desc(), F.col("type"), F.col("id")], top)
    return feed.drop("id")


def recent_activity_topk(t: Tables, top: int = 10) -> DataFrame:
    return activity_feed(t, top=top)


def dashboard_summary(t: Tables, as_of, *, days: int = 7) -> DataFrame:
    """One row per user for the day ``as_of``: recent workouts and cardio, last weight, today's food.

    Every fact is filtered by date at the scan and reduced to one row per user before
    it meets the users.
    """
    user = F.col("user_id").alias("_user")
    workouts = filter_since(t["workout_sessions"], "session_date", as_of, days).groupBy(user).agg(
        F.count(F.lit(1)).alias("workouts_count"),
        F.sum("duration_min").alias("workouts_total_min"),
    )
    cardio = filter_since(t["cardio_sessions"], "session_date", as_of, days).groupBy(user).agg(
        F.count(F.lit(1)).alias("cardio_count"),
        F.sum("distance_km").alias("cardio_total_km"),
        F.sum("steps").alias("cardio_total_steps"),
    )
    weight = latest_metric(t).select(user, "weight_lbs", "body_fat_pct", "bmi", "measurement_date")
    today = t["nutrition_log"].filter(F.col("log_date") == as_date(as_of)).groupBy(user).agg(
        F.sum("calories_kcal").alias("nutrition_calories"),
        F.round(F.sum("protein_g"), 1).alias("nutrition_protein_g"),
        F.count(F.lit(1)).alias("nutrition_entry_count"),
    )
    users = t["users"].select(F.col("id").alias("user_id"))
    joined = users
    for part in (workouts, cardio, weight, today):
        joined = joined.join(part, joined["user_id"] == part["_user"], "left").drop("_user")

    def zero(name: str):
        return F.coalesce(name, F.lit(0)).alias(name)

    return joined.select(
        "user_id",
        zero("workouts_count"), zero("workouts_total_min"),
        zero("cardio_count"), zero("cardio_total_km"), zero("cardio_total_steps"),
        "weight_lbs", "body_fat_pct", "bmi", "measurement_date",
        zero("nutrition_calories"), zero("nutrition_protein_g"), zero("nutrition_entry_count"),
    )
