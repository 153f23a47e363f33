"""Gym equipment, the shared library and gyms."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.functions.health import effective_oos

Tables = Mapping[str, DataFrame]


def visible_equipment(library: DataFrame) -> DataFrame:
    """Library rows not hidden by flags; an unknown flag hides too."""
    return library.filter(~F.col("is_flagged"))


def open_report_count(t: Tables) -> DataFrame:
    """Unresolved reports per machine, 0 where there are none."""
    counts = (
        t["equipment_oos_reports"]
        .filter(F.col("resolved_at").isNull())
        .groupBy(F.col("gym_equipment_id").alias("_machine"))
        .agg(F.count(F.lit(1)).alias("_open"))
    )
    return (
        t["gym_equipment"]
        .join(counts, F.col("id") == F.col("_machine"), "left")
        .withColumn("oos_report_count", F.coalesce("_open", F.lit(0)))
        .drop("_machine", "_open")
    )


DETAIL = (
    "id", "gym_id", "equipment_id", "equipment_name", "brand", "type", "category", "condition",
    "weight_min_lbs", "weight_max_lbs", "notes", "is_out_of_service", "oos_reported_at",
    "oos_auto_clear_at", "is_flagged", "flag_count", "added_by", "added_at",
)


def gym_equipment_detail(t: Tables, as_of, gym_id=None) -> DataFrame:
    """Machines of all gyms, or of one, with library names and current status."""
    library = visible_equipment(t["equipment_library"]).select(
        F.col("id").alias("_library_id"), F.col("name").alias("equipment_name"), "brand", "type",
        "category",
    )
    if gym_id is not None:
        t = ChainMap({"gym_equipment": t["gym_equipment"].filter(F.col("gym_id") == gym_id)}, t)
    return (
        open_report_count(t)
        .join(library, F.col("equipment_id") == F.col("_library_id"))
        .select(
            *DETAIL,
            effective_oos(
                F.col("is_out_of_service"), F.col("oos_auto_clear_at"), as_of
            ).alias("effective_oos"),
            "oos_report_count",
        )
    )


def library_with_gym_count(t: Tables) -> DataFrame:
    """Visible library rows with the number of gyms that have them."""
    counts = (
        t["gym_equipment"]
        .groupBy(F.col("equipment_id").alias("_equipment"))
        .agg(F.count(F.lit(1)).alias("_gyms"))
    )
    return (
        visible_equipment(t["equipment_library"])
        .join(counts, F.col("id") == F.col("_equipment"), "left")
        .select(
            "id", "name", "brand", "type", "category", "is_flagged", "created_by", "created_at",
            F.coalesce("_gyms", F.lit(0)).alias("gym_count"),
        )
    )


def _contains(c: Column, text: str) -> Column:
    """Case-blind containment; % and _ in the text keep their LIKE meaning."""
    return F.like(F.lower(c), F.lower(F.lit(f"%{text}%")))


def search_library(
    t: Tables, q: str | None = None, type: str | None = None, category: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Library entries by text, type and category, most widespread first."""
    found = t["equipment_library"]
    if q:
        found = found.filter(_contains(F.col("name"), q) | _contains(F.col("brand"), q))
    if type:
        found = found.filter(F.col("type") == type)
    if category:
        found = found.filter(F.col("category") == category)
    counted = library_with_gym_count(ChainMap({"equipment_library": found}, t))
    if limit is None:
        return counted
    return counted.orderBy(F.col("gym_count").desc(), F.col("name"), F.col("id")).limit(limit)


def top_library(t: Tables, limit: int = 50) -> DataFrame:
    return search_library(t, limit=limit)


def gym_workout_summary(t: Tables) -> DataFrame:
    """Gyms with their number of workouts."""
    counts = (
        t["workout_sessions"]
        .filter(F.col("gym_id").isNotNull())
        .groupBy(F.col("gym_id").alias("_gym"))
        .agg(F.count(F.lit(1)).alias("_workouts"))
    )
    gyms = t["gyms"]
    return gyms.join(counts, F.col("id") == F.col("_gym"), "left").select(
        *gyms.columns, F.coalesce("_workouts", F.lit(0)).alias("workout_count")
    )


def gym_list(t: Tables) -> DataFrame:
    """All gyms with their workouts, default gyms first."""
    return gym_workout_summary(t).orderBy(F.col("is_default").desc_nulls_first(), F.col("name"))


SEARCHED = ("id", "name", "address", "city", "state", "zip", "gym_type", "is_24hr", "workout_count")


def search_gyms(t: Tables, q: str | None, limit: int | None = None) -> DataFrame:
    """Gyms by part of name or city, or start of the zip code, busiest first.

    Fewer than two characters after trimming find nothing; the text is matched as given.
    """
    gyms = t["gyms"]
    if not q or len(q.strip()) < 2:
        match = F.lit(False)
    else:
        match = (
            _contains(F.col("name"), q) | _contains(F.col("city"), q)
            | F.like(F.col("zip"), F.lit(f"{q}%"))
        )
    found = gym_workout_summary(ChainMap({"gyms": gyms.filter(match)}, t)).select(*SEARCHED)
    if limit is None:
        return found
    return found.orderBy(F.col("workout_count").desc(), F.col("name"), F.col("id")).limit(limit)


def top_gyms(t: Tables, limit: int = 20) -> DataFrame:
    found = gym_workout_summary(t).select(*SEARCHED)
    return found.orderBy(F.col("workout_count").desc(), F.col("name"), F.col("id")).limit(limit)
