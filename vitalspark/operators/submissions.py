"""Batches sent in by users: checked, given their defaults, then applied as changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.functions.numbers import blank_to_null, zero_to_null
from vitalspark.functions.text import contains_listed_word, is_email, normalise_email
from vitalspark.operators.changes import Change, insert_if_absent, replace_rows, resolve_exercise_ids
from vitalspark.shape import with_columns_once

FLAGGED = "content flagged"

# Columns of a gym that an edit overwrites, with their defaults.
GYM_COLUMNS = {
    "name": None, "address": None, "city": None, "state": None, "zip": None, "phone": None,
    "website": None, "gym_type": "Commercial chain", "is_24hr": False, "notes": None,
    "is_default": False, "hours_mon": None, "hours_tue": None, "hours_wed": None,
    "hours_thu": None, "hours_fri": None, "hours_sat": None, "hours_sun": None,
}


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _trimmed(c: str) -> Column:
    return blank_to_null(F.trim(c))


def _judged(batch: DataFrame, reason: Column) -> DataFrame:
    """The batch with its reason, worked out once per row: screening reads whole texts."""
    return with_columns_once(batch, {"reason": reason})


def submit_library_entries(library: DataFrame, batch: DataFrame) -> Change:
    """New library machines (name, brand, type, category): named, screened, trimmed, new."""
    reason = F.when(_missing("name"), "name is required").when(
        contains_listed_word(F.col("name"), F.col("brand"), F.col("category")), FLAGGED
    )
    ready = _judged(batch, reason).withColumns({
        "name": F.trim("name"),
        "brand": _trimmed("brand"),
        "type": F.coalesce(blank_to_null(F.col("type")), F.lit("other")),
        "category": F.coalesce(blank_to_null(F.col("category")), F.lit("Other")),
    })
    return insert_if_absent(library, ready, ["name", "brand"])


def submit_gym_equipment(machines: DataFrame, batch: DataFrame) -> Change:
    """Machines seen at a gym (gym_id, equipment_id, condition, weights, notes), one per pair."""
    reason = F.when(F.col("equipment_id").isNull(), "equipment_id is required").when(
        contains_listed_word(F.col("notes")), FLAGGED
    )
    ready = _judged(batch, reason).withColumns({
        "condition": F.coalesce(blank_to_null(F.col("condition")), F.lit("good")),
        "weight_min_lbs": zero_to_null(F.col("weight_min_lbs")),
        "weight_max_lbs": zero_to_null(F.col("weight_max_lbs")),
        "notes": _trimmed("notes"),
    })
    return insert_if_absent(machines, ready, ["gym_id", "equipment_id"])


def edit_gym_equipment(machines: DataFrame, batch: DataFrame, as_of=None) -> Change:
    """Overwrite condition, weights and notes of machines (id, gym_id) with screened notes."""
    judged = _judged(batch, F.when(contains_listed_word(F.col("notes")), FLAGGED))
    clean = judged.filter(F.col("reason").isNull()).drop("reason")
    done = replace_rows(
        machines, clean, ["id", "gym_id"],
        {"condition": "good", "weight_min_lbs": None, "weight_max_lbs": None, "notes": None}, as_of,
    )
    flagged = judged.filter(F.col("reason").isNotNull())
    return done._replace(batch=done.batch.unionByName(flagged))


def edit_gyms(gyms: DataFrame, batch: DataFrame, as_of=None) -> Change:
    """Overwrite whole gym profiles by id; what an edit leaves out is cleared."""
    columns = {c: d for c, d in GYM_COLUMNS.items() if c in gyms.columns}
    absent = {c: F.lit(None).cast(gyms.schema[c].dataType) for c in columns if c not in batch.columns}
    return replace_rows(gyms, batch.withColumns(absent), ["id"], columns, as_of)


def submit_exercises(exercises: DataFrame, muscle_groups: DataFrame, batch: DataFrame) -> Change:
    """Custom exercises (name, muscle_group, equipment); an unknown muscle group is null."""
    named = batch.withColumns({
        "reason": F.when(_missing("name"), "name is required"),
        "equipment": blank_to_null(F.col("equipment")),
        "is_custom": F.lit(True),
    })
    return insert_if_absent(exercises, resolve_exercise_ids(named, muscle_groups), ["name"])


def submit_lookup(current: DataFrame, batch: DataFrame) -> Change:
    """Custom muscle groups or cardio types by name."""
    named = batch.withColumns({
        "reason": F.when(_missing("name"), "name is required"), "is_custom": F.lit(True),
    })
    return insert_if_absent(current, named, ["name"])


def submit_waitlist(waitlist: DataFrame, batch: DataFrame) -> Change:
    """Waitlist signups by email, stored lower case and trimmed."""
    ready = batch.withColumns({
        "reason": F.when(~is_email(F.col("email")), "valid email required"),
        "email": normalise_email(F.col("email")),
    })
    return insert_if_absent(waitlist, ready, ["email"])
