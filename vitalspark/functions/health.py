"""Clinical and equipment status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspark.functions.dates import as_timestamp


def bp_class(systolic: Column, diastolic: Column) -> Column:
    """Class of a reading. The third rule joins its limits with OR, so 165/85 is stage 1."""
    return (
        F.when((systolic < 120) & (diastolic < 80), "Normal")
        .when((systolic < 130) & (diastolic < 80), "Elevated")
        .when((systolic < 140) | (diastolic < 90), "High Stage 1")
        .when((systolic >= 140) | (diastolic >= 90), "High Stage 2")
        .otherwise("Unknown")
    )


def clear_time_passed(is_out: Column, clear_at: Column, as_of) -> Column:
    return is_out & clear_at.isNotNull() & (clear_at < as_timestamp(as_of))


def effective_oos(is_out: Column, clear_at: Column, as_of) -> Column:
    """Out of service unless the automatic clear time has passed."""
    return F.when(clear_time_passed(is_out, clear_at, as_of), F.lit(False)).otherwise(is_out)
