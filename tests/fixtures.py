"""Hand-made rows: the sample training log, and tables with every edge on them."""

from vitalspark.schemas import table_schema
from vitalspark.sources.seeds import conform

SETS = [
    ("Bench Press", 1, 8, "185.0", "7.0"), ("Bench Press", 2, 8, "185.0", "7.5"),
    ("Bench Press", 3, 6, "195.0", "8.5"), ("Incline DB Press", 1, 10, "65.0", "7.0"),
    ("Incline DB Press", 2, 10, "65.0", "7.5"), ("Overhead Press", 1, 8, "95.0", "7.0"),
    ("Overhead Press", 2, 8, "95.0", "8.0"),
]
CARDIO = [
    ("2025-04-13", "Run", "5.2", 28, 158, 6800), ("2025-04-11", "Cycle", "18.0", 45, 142, None),
    ("2025-04-09", "Walk", "3.1", 40, 115, 4200),
]
WEIGHTS = [
    ("2025-04-15 07:12:00", "187.4", "19.2"), ("2025-04-14 07:08:00", "188.0", "19.4"),
    ("2025-04-13 07:22:00", "187.8", "19.3"), ("2025-04-12 07:15:00", "188.6", "19.5"),
    ("2025-04-11 07:05:00", "189.1", "19.7"),
]
MEALS = [
    ("Breakfast", 220, "18.0", "28.0", "4.0"), ("Breakfast", 310, "10.0", "54.0", "6.0"),
    ("Lunch", 520, "45.0", "52.0", "8.0"), ("Snack", 160, "25.0", "8.0", "3.0"),
    ("Dinner", 480, "38.0", "22.0", "22.0"),
]


def make(spark, table, columns, rows):
    """Rows given as text or numbers, cast to the table's types; absent columns are null."""
    kinds = {f.name: f.dataType for f in table_schema(table).fields}
    texts = [tuple(None if v is None else str(v) for v in r) for r in rows]
    raw = spark.createDataFrame(texts, ", ".join(f"{c} string" for c in columns))
    typed = raw.select(*[raw[c].cast(kinds[c]).alias(c) for c in columns])
    return conform(typed, table)


def sample_log(spark):
    sessions = make(
        spark, "workout_sessions", ["id", "user_id", "session_date", "name", "duration_min"],
        [("s1", "u1", "2025-04-14", "Push Day", 55)],
    )
    sets = make(
        spark, "workout_sets",
        ["id", "session_id", "exercise_name", "set_number", "reps", "weight_lbs", "rpe"],
        [(f"x{i}", "s1", *s) for i, s in enumerate(SETS)],
    )
    cardio = make(
        spark, "cardio_sessions",
        ["id", "user_id", "session_date", "activity_type", "distance_km", "duration_min", "avg_hr_bpm", "steps"],
        [(f"c{i}", "u1", *c) for i, c in enumerate(CARDIO)],
    )
    weights = make(
        spark, "body_metrics",
        ["id", "user_id", "measured_at", "measurement_date", "weight_lbs", "body_fat_pct", "source"],
        [(f"w{i}", "u1", m, m[:10], w, f, "renpho") for i, (m, w, f) in enumerate(WEIGHTS)],
    )
    meals = make(
        spark, "nutrition_log",
        ["id", "user_id", "log_date", "meal_type", "food_name", "calories_kcal", "protein_g", "carbs_g", "fat_g"],
        [(f"m{i}", "u1", "2025-04-15", k, "food", *v) for i, (k, *v) in enumerate(MEALS)],
    )

    def empty(name):
        return spark.createDataFrame([], table_schema(name))

    return {
        "workout_sessions": sessions, "workout_sets": sets, "cardio_sessions": cardio,
        "body_metrics": weights, "nutrition_log": meals,
        **{n: empty(n) for n in ("gym_equipment", "equipment_library", "gyms", "exercises", "muscle_groups")},
        "users": make(spark, "users", ["id", "email", "role"], [("u1", "a@b.c", "member"), ("u2", "d@e.f", "member")]),
    }
