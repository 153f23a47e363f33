"""Pages of history per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.skew import row_positions

# Largest row_number bound Spark still cuts on the map side.
GROUP_LIMIT = 1000


def page_rows(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    order: Sequence[Column],
    *,
    limit: int,
    offset: int = 0,
) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` of each group, newest day first.

    ``order`` must start with ``day`` descending. Shallow pages are cut on the map
    side; deep ones are numbered day by day instead of sorting a whole group.
    """
    first, last = offset + 1, offset + limit
    if last <= GROUP_LIMIT:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        placed = df.withColumn("_place", place)
    else:
        placed = row_positions(
            df, keys, F.col(day), order, descending=True, name="_place"
        )
    return placed.filter(F.col("_place").between(first, last)).drop("_place")


def _page(df, keys, day, rest, limit, offset):
    order = [F.col(day).desc(), *rest, F.col("id").desc()]
    return page_rows(df, keys, day, order, limit=limit, offset=offset)


def metrics_page(df: DataFrame, keys=("user_id",), limit: int = 90, offset: int = 0) -> DataFrame:
    return _page(df, keys, "measurement_date", [F.col("measured_at").desc()], limit, offset)


def cardio_page(df: DataFrame, keys=("user_id",), limit: int = 50, offset: int = 0) -> DataFrame:
    newest = [F.col("created_at").desc_nulls_first()]
    return _page(df, keys, "session_date", newest, limit, offset)


def nutrition_page(
    df: DataFrame, keys=("user_id",), day=None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Entries of all days or of one; with ``limit`` a page of them, newest first."""
    if day is not None:
        df = df.filter(F.col("log_date") == F.lit(day).cast("date"))
    if limit is None:
        return df
    return _page(df, keys, "log_date", [F.col("created_at").desc_nulls_first()], limit, offset)
