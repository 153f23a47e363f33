"""Rounding, means and unit conversion, all in decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion and formula constants.
POUNDS_PER_KG = Decimal("2.20462")
MILES_PER_KM = Decimal("0.621371")
METRES_PER_KM = Decimal("1000")
ONE_REP_MAX_FACTOR = Decimal("0.0333")


def round_to_int(c: Column) -> Column:
    """Nearest whole number; a plain cast would cut the fraction off."""
    return F.round(c).cast("int")


def mean_rounded(c: Column, digits: int) -> Column:
    """Exact mean of any numeric column, rounded half away from zero."""
    return F.round(F.avg(c.cast("decimal(20,12)")), digits)


def metres_to_km(c: Column) -> Column:
    return F.round(c / F.lit(METRES_PER_KM), 2)


def km_to_miles(c: Column) -> Column:
    return F.round(c * F.lit(MILES_PER_KM), 2)


def kg_to_lbs(c: Column) -> Column:
    return F.round(c * F.lit(POUNDS_PER_KG), 2)


def one_rep_max(weight: Column, reps: Column) -> Column:
    """Unrounded estimate; null when reps are unknown."""
    return weight * (F.lit(1) + F.lit(ONE_REP_MAX_FACTOR) * reps.cast("decimal(5,0)"))


NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column, kind: str) -> Column:
    """Text as a number, else null; the shape test spares the cost of failed casts."""
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast(kind))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
