"""Reading and writing the stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.schemas import table_schema
from vitalspark.session import work_dir

# Date column that decides the month partition of each time-based table.
MONTH_OF = {
    "workout_sessions": "session_date",
    "cardio_sessions": "session_date",
    "body_metrics": "measurement_date",
    "nutrition_log": "log_date",
    "sleep_sessions": "session_date",
    "heart_rate": "measurement_date",
    "heart_rate_daily": "summary_date",
    "blood_oxygen": "measurement_date",
    "blood_pressure": "measurement_date",
    "stress_readings": "measurement_date",
    "daily_activity": "activity_date",
    "samsung_workouts": "session_date",
}


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One stored table with its declared types; no schema inference."""
    schema = table_schema(name)
    if name in MONTH_OF:
        schema = schema.add("month", "string")
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")


def scan_all(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: scan_table(spark, root, name) for name in names}


def _laid_by_month(df: DataFrame, name: str) -> DataFrame:
    """Rows ranged by date, so one busy month is spread over several tasks and files carry
    narrow min/max statistics."""
    day = MONTH_OF[name]
    others = [c for c in ("user_id", "id") if c in df.columns]
    df = df.withColumn("month", F.date_format(day, "yyyy-MM"))
    return df.repartitionByRange("month", day, *others).sortWithinPartitions("month", day)


def store_table(df: DataFrame, root: str, name: str) -> str:
    """Write a table as its whole truth: rows stored before that ``df`` lacks are gone.

    Time-based tables are partitioned by month. ``df`` must not read the stored table itself;
    changes go through ``change_months``.
    """
    path = f"{root.rstrip('/')}/{name}"
    if name in MONTH_OF:
        writer = _laid_by_month(df, name).write.partitionBy("month")
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, months: Sequence[str]) -> None:
    """Replace the named months of a table partitioned by ``month``, those left empty too.

    ``df`` has a ``month`` column and no rows of other months. Files of other months stay.
    """
    found = {r.month for r in df.select("month").distinct().collect()}
    if not found <= set(months):
        raise ValueError(f"rows of months that are not replaced: {sorted(map(str, found - set(months)))}")
    if found:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(path))
    none = df.drop("month").limit(0)
    for month in sorted(set(months) - found):
        none.write.mode("overwrite").parquet(f"{path}/month={month}")


def change_months(
    spark: SparkSession, root: str, name: str, months: Sequence[str],
    change: Callable[[DataFrame], DataFrame],
) -> None:
    """Apply ``change`` to the named months of a stored table; reads and writes only those.

    ``months`` must name every month a row leaves or enters. The new rows are written to the
    scratch folder first, since they come from the files they replace.
    """
    stored = scan_table(spark, root, name)
    old = stored.filter(F.col("month").isin(list(months))).drop("month")
    draft = work_dir(spark, f"change-{name}")
    change(old).write.parquet(draft)
    new = spark.read.schema(old.schema).parquet(draft)
    replace_partitions(_laid_by_month(new, name), f"{root.rstrip('/')}/{name}", months)
