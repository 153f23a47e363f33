"""Incoming documents turned into table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.functions.numbers import blank_to_null, zero_to_null
from vitalspark.operators.quality import Split
from vitalspark.schemas import NUTRITION_ENTRY_DDL, WORKOUT_DOCUMENT_DDL
from vitalspark.shape import with_columns_once


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def parse_workout_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to the fields of a workout document, other columns kept."""
    parsed = with_columns_once(documents, {"_d": F.from_json(column, WORKOUT_DOCUMENT_DDL)})
    return parsed.select(*[c for c in documents.columns if c != column], "_d.*")


def ingest_workout_documents(documents: DataFrame) -> tuple[Split, DataFrame]:
    """Workout documents to session rows and set rows.

    ``documents`` holds the document fields plus ``session_id`` (given once on
    arrival, stable on re-runs) and ``user_id``. Documents lacking a date or a name
    go to the rejected side. Sets are numbered from 1 within each exercise entry.
    """
    reason = F.when(_missing(F.col("date")), "date is required").when(
        _missing(F.col("name")), "name is required"
    ).when(F.col("date").try_cast("date").isNull(), "date is not a date")
    tagged = documents.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).drop("reason")
    sessions = good.select(
        F.col("session_id").alias("id"),
        "user_id",
        F.col("date").try_cast("date").alias("session_date"),
        "name",
        zero_to_null(F.col("duration_min")).alias("duration_min"),
        blank_to_null(F.col("notes")).alias("notes"),
        blank_to_null(F.col("gym_id")).alias("gym_id"),
    )
    entries = good.select("session_id", F.posexplode("exercises").alias("exercise_position", "ex"))
    sets = entries.select(
        "session_id",
        "exercise_position",
        F.col("ex.name").alias("exercise_name"),
        blank_to_null(F.col("ex.gym_equipment_id")).alias("gym_equipment_id"),
        F.posexplode("ex.sets").alias("_pos", "s"),
    ).select(
        "session_id",
        "exercise_position",
        "exercise_name",
        (F.col("_pos") + 1).cast("smallint").alias("set_number"),
        zero_to_null(F.col("s.reps")).alias("reps"),
        zero_to_null(F.col("s.weight_lbs")).alias("weight_lbs"),
        zero_to_null(F.col("s.rpe")).alias("rpe"),
        blank_to_null(F.col("s.notes")).alias("notes"),
        "gym_equipment_id",
    )
    return Split(sessions, tagged.filter(F.col("reason").isNotNull())), sets


def ingest_nutrition_entries(posts: DataFrame, column: str = "value") -> Split:
    """JSON text holding one entry or a list of them; entries without a date are set aside."""
    kept = [c for c in posts.columns if c != column]
    is_list = F.substring(F.ltrim(column), 1, 1) == "["
    as_list = F.when(is_list, F.col(column)).otherwise(F.concat(F.lit("["), column, F.lit("]")))
    entry = T.ArrayType(T.StructType.fromDDL(NUTRITION_ENTRY_DDL))
    rows = posts.select(
        *kept, F.posexplode_outer(F.from_json(as_list, entry)).alias("entry_position", "e")
    ).select(*kept, "entry_position", "e.*")
    day = F.col("log_date").try_cast("date")
    reason = F.when(_missing(F.col("log_date")), "log_date is required").when(
        day.isNull(), "log_date is not a date"
    )
    tagged = rows.withColumn("reason", reason)
    accepted = tagged.filter(F.col("reason").isNull()).select(
        *kept,
        "entry_position",
        day.alias("log_date"),
        blank_to_null(F.col("meal_type")).alias("meal_type"),
        blank_to_null(F.col("food_name")).alias("food_name"),
        *[
            zero_to_null(F.col(c)).alias(c)
            for c in ("calories_kcal", "protein_g", "carbs_g", "fat_g")
        ],
        blank_to_null(F.col("notes")).alias("notes"),
    )
    return Split(accepted, tagged.filter(F.col("reason").isNotNull()))


def ingest_metrics(rows: DataFrame, as_of) -> DataFrame:
    """Manual body measurements with their defaults; zeros become null."""
    numbers = [
        c for c in (
            "weight_lbs", "body_fat_pct", "muscle_mass_lbs", "bmi", "bone_mass_lbs",
            "body_water_pct", "visceral_fat", "metabolic_age",
        ) if c in rows.columns
    ]
    return rows.withColumns({
        **{c: zero_to_null(F.col(c)) for c in numbers},
        "source": F.coalesce(blank_to_null(F.col("source")), F.lit("manual")),
        "measured_at": F.coalesce(F.col("measured_at"), F.lit(as_of).cast("timestamp")),
    })


def ingest_cardio(rows: DataFrame) -> Split:
    tagged = rows.withColumns({
        "activity_type": F.coalesce(blank_to_null(F.col("activity_type")), F.lit("Other")),
        "duration_min": zero_to_null(F.col("duration_min")),
        "distance_km": zero_to_null(F.col("distance_km")),
        "notes": blank_to_null(F.col("notes")),
        "reason": F.when(F.col("session_date").isNull(), "session_date is required"),
    })
    return Split.by_reason(tagged)


def ingest_gyms(rows: DataFrame) -> Split:
    texts = [
        c for c in (
            "address", "city", "state", "zip", "phone", "website", "notes", "hours_mon",
            "hours_tue", "hours_wed", "hours_thu", "hours_fri", "hours_sat", "hours_sun",
        ) if c in rows.columns
    ]
    tagged = rows.withColumns({
        **{c: blank_to_null(F.col(c)) for c in texts},
        "gym_type": F.coalesce(blank_to_null(F.col("gym_type")), F.lit("Commercial chain")),
        "is_24hr": F.coalesce(F.col("is_24hr"), F.lit(False)),
        "is_default": F.coalesce(F.col("is_default"), F.lit(False)),
        "reason": F.when(_missing(F.col("name")), "name is required"),
    })
    return Split.by_reason(tagged)
