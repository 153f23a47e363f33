"""Calendar expressions. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspark.functions.numbers import to_number

# Names of the epoch fields a scale may send, in order of preference.
SCALE_EPOCH_FIELDS = ("timeStamp", "time_stamp", "timestamp")
SCALE_LOCAL_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
SCALE_LOCAL_FORMAT = "yyyy-M-d H:m:s"
# Epoch seconds of the years 1 to 9999; others are unreadable.
FIRST_EPOCH, AFTER_EPOCH = -62_135_596_800, 253_402_300_800


def as_date(as_of) -> Column:
    return as_of.cast("date") if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def as_timestamp(as_of) -> Column:
    return as_of.cast("timestamp") if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def week_start(c: Column) -> Column:
    """Monday of the week."""
    return F.trunc(c, "week")


def days_before(as_of, days: int) -> Column:
    return F.date_sub(as_date(as_of), days)


def first_epoch_text(fields: list[Column]) -> Column:
    """First field that is present; empty text and zero count as absent."""
    return F.coalesce(
        *[F.when((F.trim(c) != "") & ~F.trim(c).isin("0", "0.0"), F.trim(c)) for c in fields]
    )


def parse_scale_time(fields: list[Column], local_text: Column, as_of) -> Column:
    """Epoch seconds, else local text read as UTC, else ``as_of``.

    Once an epoch field is present but unreadable the other epoch fields are not
    tried; the local text is.
    """
    seconds = to_number(first_epoch_text(fields), "double")
    usable = F.when((seconds >= FIRST_EPOCH) & (seconds < AFTER_EPOCH), seconds)
    local = F.when(
        local_text.rlike(SCALE_LOCAL_SHAPE),
        F.try_to_timestamp(local_text, F.lit(SCALE_LOCAL_FORMAT)),
    )
    return F.coalesce(F.timestamp_seconds(usable), local, as_timestamp(as_of))
