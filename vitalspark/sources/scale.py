"""Scale readings: text fields in, typed measurements out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.functions.dates import SCALE_EPOCH_FIELDS, parse_scale_time
from vitalspark.functions.numbers import kg_to_lbs, to_number
from vitalspark.schemas import SCALE_FIELDS
from vitalspark.shape import with_columns_once

# Reading field -> (measurement column, stored type, is a mass in kg).
SCALE_COLUMNS = {
    "weight": ("weight_lbs", "decimal(6,2)", True),
    "bodyfat": ("body_fat_pct", "decimal(5,2)", False),
    "muscle": ("muscle_mass_lbs", "decimal(6,2)", True),
    "bone": ("bone_mass_lbs", "decimal(5,2)", True),
    "water": ("body_water_pct", "decimal(5,2)", False),
    "visfat": ("visceral_fat", "smallint", False),
    "bmi": ("bmi", "decimal(5,2)", False),
    "bmr": ("bmr_kcal", "int", False),
    "bodyage": ("metabolic_age", "smallint", False),
}


def scan_scale_readings(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """JSON readings with every field as text; ``extra`` names further text fields."""
    return reading_columns(spark.read.text(path), (*SCALE_FIELDS, *extra))


def reading_columns(
    lines: DataFrame, fields: Sequence[str] = SCALE_FIELDS, source: str = "value"
) -> DataFrame:
    """Fields of JSON text lines, in one pass over the text.

    ``timeStamp`` and ``timestamp`` are different fields: names are matched by case, and
    the first is renamed so that no two columns differ in case only.
    """
    kept = [c for c in lines.columns if c != source]
    return lines.select(
        *kept, F.json_tuple(source, *fields).alias(*[plain_name(f) for f in fields])
    )


def plain_name(field: str) -> str:
    return "epoch_camel" if field == "timeStamp" else field


def read_scale_measurements(readings: DataFrame, as_of, *carry: str) -> DataFrame:
    """Typed measurements with ``rejected_field`` naming the first unreadable field.

    Empty text and zero count as absent. Masses are converted to pounds. A row with
    a value that is not a number, or does not fit its column, is marked, not dropped.
    """
    times = [F.col(plain_name(f)) for f in SCALE_EPOCH_FIELDS]
    measured = parse_scale_time(times, F.col("localCreatedAt"), as_of)
    # steps that name their results, so that no text is converted twice
    numbers = readings.select(
        *carry,
        measured.alias("measured_at"),
        *[F.nullif(F.trim(f), F.lit("")).alias(f"_t_{f}") for f in SCALE_COLUMNS],
        *[to_number(F.trim(f), "decimal(20,6)").alias(f"_n_{f}") for f in SCALE_COLUMNS],
    )
    values, problems = {}, []
    for field, (column, kind, mass) in SCALE_COLUMNS.items():
        number = F.nullif(F.col(f"_n_{field}"), F.lit(0))
        if mass:
            number = kg_to_lbs(number)
        elif kind in ("int", "smallint"):
            number = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        values[column] = number.try_cast(kind)
        present = F.col(f"_t_{field}").isNotNull() & ~F.col(f"_n_{field}").eqNullSafe(F.lit(0))
        problems.append(F.when(present & F.col(column).isNull(), F.lit(field)))
    return (
        with_columns_once(numbers, values)
        .withColumns({
            "rejected_field": F.coalesce(*problems),
            "measurement_date": F.col("measured_at").cast("date"),
        })
        .drop(*[f"_{p}_{f}" for f in SCALE_COLUMNS for p in "tn"])
    )
