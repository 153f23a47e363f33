"""The reporting marts: what they hold, how they are ordered, how they are stored."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.operators import body_health, cardio_nutrition, equipment, strength
from vitalspark.session import work_dir
from vitalspark.sources.tables import replace_partitions

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Mart:
    build: Callable[..., DataFrame]
    order: Sequence[tuple[str, str]]
    period: str | None = None
    needs_now: bool = False

    def frame(self, t: Tables, as_of=None) -> DataFrame:
        if not self.needs_now:
            return self.build(t)
        if as_of is None:
            raise ValueError("this mart needs as_of")
        return self.build(t, as_of)

    def order_columns(self) -> list[Column]:
        return [
            F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last()
            for c, way in self.order
        ]


MARTS = {
    "daily_nutrition": Mart(cardio_nutrition.daily_nutrition, [("log_date", "desc")], "log_date"),
    "weekly_workouts": Mart(strength.weekly_workouts, [("week_start", "desc")], "week_start"),
    "weekly_cardio": Mart(cardio_nutrition.weekly_cardio, [("week_start", "desc")], "week_start"),
    "weight_trend": Mart(body_health.weight_trend, [("measurement_date", "desc")], "measurement_date"),
    "exercise_prs": Mart(strength.exercise_prs, [("exercise", "asc")]),
    "workout_detail": Mart(
        strength.workout_detail, [("session_date", "desc"), ("set_number", "asc")], "session_date"
    ),
    "daily_health_summary": Mart(
        body_health.daily_health_summary, [("summary_date", "desc")], "summary_date"
    ),
    "weekly_sleep": Mart(body_health.weekly_sleep, [("week_start", "desc")], "week_start"),
    "hr_trend": Mart(body_health.hr_trend, [("summary_date", "desc")], "summary_date"),
    "blood_pressure_log": Mart(
        body_health.blood_pressure_log, [("measured_at", "desc")], "measurement_date"
    ),
    "samsung_workout_history": Mart(
        body_health.samsung_workout_history, [("session_date", "desc")], "session_date"
    ),
    "library_with_gym_count": Mart(
        equipment.library_with_gym_count, [("category", "asc"), ("name", "asc")]
    ),
    "gym_equipment_detail": Mart(
        equipment.gym_equipment_detail, [("category", "asc"), ("equipment_name", "asc")],
        needs_now=True,
    ),
    "personal_records": Mart(strength.personal_records, [("max_weight_lbs", "desc")]),
}


def ordered(name: str, t: Tables, as_of=None) -> DataFrame:
    """A mart in its declared order, for a reader that shows it."""
    mart = MARTS[name]
    return mart.frame(t, as_of).orderBy(*mart.order_columns())


def publish_mart(
    name: str, t: Tables, root: str, as_of=None, months: Sequence[str] | None = None
) -> str:
    """Store a mart by month, newest first within each file.

    The stored mart is replaced whole, or in the named ``months`` alone, months that have no
    rows any more included. Rows are ranged over (month, order, user)
    first, so a month or user with most of the rows is still written by several tasks.
    """
    mart = MARTS[name]
    df = mart.frame(t, as_of)
    path = f"{root.rstrip('/')}/{name}"
    spread = [F.col(c) for c in ("user_id", "id") if c in df.columns]
    if mart.period is None:
        laid = df.repartitionByRange(*mart.order_columns(), *spread)
        laid.sortWithinPartitions(*mart.order_columns()).write.mode("overwrite").parquet(path)
        return path
    df = df.withColumn("month", F.date_format(mart.period, "yyyy-MM"))
    if months is not None:
        df = df.filter(F.col("month").isin(list(months)))
    laid = df.repartitionByRange(F.col("month"), *mart.order_columns(), *spread)
    laid = laid.sortWithinPartitions(F.col("month"), *mart.order_columns())
    if months is not None:
        replace_partitions(laid, path, months)
    else:
        writer = laid.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("month").parquet(path)
    return path


def publish_marts(
    t: Tables, root: str, names: Sequence[str] = tuple(MARTS), as_of=None
) -> dict[str, str]:
    return {name: publish_mart(name, t, root, as_of) for name in names}


def publish_and_read(t: Tables, measures: Mapping[str, str]) -> DataFrame:
    """Publish the named marts to the shared folder and read one measure of each back."""
    spark = t["nutrition_log"].sparkSession
    paths = publish_marts(t, work_dir(spark, "marts"), list(measures))
    rows = []
    for name, path in paths.items():
        rows.append(
            spark.read.parquet(path).select(
                F.lit(name).alias("mart"), "user_id", F.col(MARTS[name].period).alias("period"),
                F.col(measures[name]).cast("double").alias("measure"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
