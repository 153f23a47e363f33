"""Cardio and nutrition totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.functions.dates import days_before, week_start

Tables = Mapping[str, DataFrame]
USER = ("user_id",)


def daily_nutrition(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Totals per day; a total of nothing but nulls stays null."""
    return (
        t["nutrition_log"]
        .groupBy(*keys, "log_date")
        .agg(
            F.sum("calories_kcal").alias("total_calories"),
            F.sum("protein_g").alias("total_protein_g"),
            F.sum("carbs_g").alias("total_carbs_g"),
            F.sum("fat_g").alias("total_fat_g"),
            F.sum("fiber_g").alias("total_fiber_g"),
            F.count(F.lit(1)).alias("entry_count"),
        )
    )


def weekly_cardio(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Totals per Monday week and activity."""
    return (
        t["cardio_sessions"]
        .groupBy(*keys, week_start(F.col("session_date")).alias("week_start"), "activity_type")
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.round(F.sum("distance_km"), 2).alias("total_km"),
            F.sum("duration_min").alias("total_min"),
            F.sum("steps").alias("total_steps"),
        )
    )


def filter_since(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    """Rows of the trailing window; both end days count, so 7 gives eight days."""
    return df.filter(F.col(column) >= days_before(as_of, days))


def cardio_by_day(
    t: Tables, *, keys: Sequence[str] = USER, as_of=None, days: int = 7
) -> DataFrame:
    rows = t["cardio_sessions"]
    if as_of is not None:
        rows = filter_since(rows, "session_date", as_of, days)
    return rows.groupBy(*keys, F.col("session_date").alias("date")).agg(
        F.coalesce(F.sum("distance_km"), F.lit(0)).alias("distance_km")
    )
