"""Fixed lookups every installation starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.schemas import table_schema

# Starting rows of the lookup tables.
MUSCLE_GROUPS = (
    "Chest", "Back", "Shoulders", "Biceps", "Triceps",
    "Legs", "Glutes", "Core", "Full Body", "Other",
)
EXERCISES = (
    ("Bench Press", 1, "Barbell"),
    ("Incline DB Press", 1, "Dumbbell"),
    ("Pull-Up", 2, "Bodyweight"),
    ("Barbell Row", 2, "Barbell"),
    ("Overhead Press", 3, "Barbell"),
    ("Lateral Raise", 3, "Dumbbell"),
    ("Barbell Curl", 4, "Barbell"),
    ("Hammer Curl", 4, "Dumbbell"),
    ("Tricep Pushdown", 5, "Machine"),
    ("Squat", 6, "Barbell"),
    ("Romanian Deadlift", 6, "Barbell"),
    ("Leg Press", 6, "Machine"),
    ("Hip Thrust", 7, "Barbell"),
    ("Plank", 8, "Bodyweight"),
    ("Deadlift", 9, "Barbell"),
)
EQUIPMENT_TYPES = (
    "Plate-loaded", "Selectorized", "Cable", "Smith machine", "Cardio", "Free weights",
    "Bodyweight / rig", "Stretching / mobility", "Other",
)
EQUIPMENT_CATEGORIES = (
    "Chest", "Back", "Shoulders", "Biceps", "Triceps", "Legs", "Glutes", "Core",
    "Full body", "Cardio", "Other",
)
MACHINES = (
    ("Flat Bench Press Station", "Generic", "Free weights", "Chest"),
    ("Incline Bench Press Station", "Generic", "Free weights", "Chest"),
    ("Decline Bench Press Station", "Generic", "Free weights", "Chest"),
    ("ISO Lateral Chest Press", "Hammer Strength", "Plate-loaded", "Chest"),
    ("ISO Incline Press", "Hammer Strength", "Plate-loaded", "Chest"),
    ("Chest Press", "Life Fitness", "Selectorized", "Chest"),
    ("Chest Fly / Pec Deck", "Life Fitness", "Selectorized", "Chest"),
    ("Cable Crossover", "Generic", "Cable", "Chest"),
    ("Pull-Up / Chin-Up Rig", "Generic", "Bodyweight / rig", "Back"),
    ("Lat Pulldown", "Life Fitness", "Selectorized", "Back"),
    ("Seated Cable Row", "Generic", "Cable", "Back"),
    ("ISO Lateral Row", "Hammer Strength", "Plate-loaded", "Back"),
    ("T-Bar Row", "Generic", "Plate-loaded", "Back"),
    ("Back Extension", "Generic", "Bodyweight / rig", "Back"),
    ("Shoulder Press", "Life Fitness", "Selectorized", "Shoulders"),
    ("ISO Lateral Shoulder Press", "Hammer Strength", "Plate-loaded", "Shoulders"),
    ("Lateral Raise Machine", "Life Fitness", "Selectorized", "Shoulders"),
    ("Rear Delt Fly", "Life Fitness", "Selectorized", "Shoulders"),
    ("Preacher Curl", "Life Fitness", "Selectorized", "Biceps"),
    ("Bicep Curl Machine", "Generic", "Selectorized", "Biceps"),
    ("Tricep Pushdown", "Generic", "Cable", "Triceps"),
    ("Tricep Extension", "Life Fitness", "Selectorized", "Triceps"),
    ("Dip Station", "Generic", "Bodyweight / rig", "Triceps"),
    ("Squat Rack", "Generic", "Free weights", "Legs"),
    ("Leg Press", "Hammer Strength", "Plate-loaded", "Legs"),
    ("Leg Extension", "Life Fitness", "Selectorized", "Legs"),
    ("Leg Curl (Seated)", "Life Fitness", "Selectorized", "Legs"),
    ("Leg Curl (Lying)", "Life Fitness", "Selectorized", "Legs"),
    ("Hip Abductor / Adductor", "Life Fitness", "Selectorized", "Legs"),
    ("Calf Raise (Standing)", "Generic", "Plate-loaded", "Legs"),
    ("Calf Raise (Seated)", "Life Fitness", "Selectorized", "Legs"),
    ("Smith Machine", "Generic", "Smith machine", "Full body"),
    ("Hip Thrust Machine", "Nautilus", "Selectorized", "Glutes"),
    ("Glute Kickback Machine", "Life Fitness", "Selectorized", "Glutes"),
    ("Ab Crunch Machine", "Life Fitness", "Selectorized", "Core"),
    ("Roman Chair / Hyperextension", "Generic", "Bodyweight / rig", "Core"),
    ("Cable Crunch Station", "Generic", "Cable", "Core"),
    ("Treadmill", "Life Fitness", "Cardio", "Cardio"),
    ("Elliptical", "Life Fitness", "Cardio", "Cardio"),
    ("Stationary Bike (Upright)", "Life Fitness", "Cardio", "Cardio"),
    ("Stationary Bike (Recumbent)", "Life Fitness", "Cardio", "Cardio"),
    ("Rowing Machine", "Concept2", "Cardio", "Cardio"),
    ("Stair Climber", "StairMaster", "Cardio", "Cardio"),
    ("Assault Bike", "Assault Fitness", "Cardio", "Cardio"),
    ("Jacob's Ladder", "Jacob's Ladder", "Cardio", "Cardio"),
    ("Dumbbell Rack", "Generic", "Free weights", "Full body"),
    ("Barbell Rack", "Generic", "Free weights", "Full body"),
    ("Kettlebell Rack", "Generic", "Free weights", "Full body"),
    ("Cable Machine (Dual Adjustable)", "Life Fitness", "Cable", "Full body"),
    ("Functional Trainer", "Life Fitness", "Cable", "Full body"),
)


def _named(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names, start=1)), "id int, name string")


def load_seed_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The starting lookups, typed like the stored tables and safe to broadcast.

    Load them through ``insert_if_absent`` so that seeding twice changes nothing.
    """
    machines = spark.createDataFrame(
        [(str(i), *row) for i, row in enumerate(MACHINES, start=1)],
        "id string, name string, brand string, type string, category string",
    ).withColumns({
        "is_flagged": F.lit(False),
        "flag_count": F.lit(0),
        "created_by": F.lit("community"),
    })
    exercises = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(EXERCISES, start=1)],
        "id int, name string, muscle_group_id int, equipment string",
    ).withColumn("is_custom", F.lit(False))
    seeds = {
        "muscle_groups": _named(spark, MUSCLE_GROUPS).withColumn("is_custom", F.lit(False)),
        "exercises": exercises,
        "equipment_types": _named(spark, EQUIPMENT_TYPES),
        "equipment_categories": _named(spark, EQUIPMENT_CATEGORIES),
        "equipment_library": machines,
    }
    return {name: conform(df, name) for name, df in seeds.items()}


def conform(df: DataFrame, name: str) -> DataFrame:
    """All columns of the stored table, in order; absent ones are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table_schema(name).fields
    ])
