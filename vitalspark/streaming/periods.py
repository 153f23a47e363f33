"""Daily and weekly totals kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalspark.functions.dates import week_start
from vitalspark.streaming.store import compact, read_since, write_batch


def DAY(at: Column) -> Column:
    return at.cast("date")


def WEEK(at: Column) -> Column:
    return week_start(at.cast("date"))


@dataclass(frozen=True)
class Total:
    """A total of one column over a period, from partial sums that can be added.

    ``kind`` is 'count' (of rows), 'sum' or 'mean'; ``digits`` rounds the result.
    """

    name: str
    kind: str
    column: str = ""
    digits: int | None = None

    def partials(self) -> list[Column]:
        if self.kind == "count":
            return [F.count(F.lit(1)).alias(self.name)]
        if self.kind == "sum":
            return [F.sum(self.column).alias(self.name)]
        exact = F.col(self.column).cast("decimal(20,12)")
        return [F.sum(exact).alias(self.name), F.count(exact).alias(f"{self.name}_n")]

    def merged(self) -> list[Column]:
        names = [self.name, f"{self.name}_n"] if self.kind == "mean" else [self.name]
        return [F.sum(n).alias(n) for n in names]

    def result(self) -> Column:
        value = F.col(self.name)
        if self.kind == "mean":
            value = F.when(F.col(f"{self.name}_n") > 0, value.cast("decimal(38,12)") / F.col(f"{self.name}_n"))
        return (value if self.digits is None else F.round(value, self.digits)).alias(self.name)


@dataclass(frozen=True)
class PeriodTotals:
    at: str
    period: Callable[[Column], Column]
    name: str
    totals: tuple[Total, ...]
    extra: tuple[str, ...] = ()

    def by(self, keys: Sequence[str]) -> list[str]:
        return [*keys, self.name, *self.extra]

    def merged(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Partial sums of each (keys, period), added up; adding them up again changes nothing."""
        return rows.groupBy(*self.by(keys)).agg(*[c for total in self.totals for c in total.merged()])


def daily_nutrition() -> PeriodTotals:
    return PeriodTotals("log_date", DAY, "log_date", (
        Total("total_calories", "sum", "calories_kcal"),
        Total("total_protein_g", "sum", "protein_g"),
        Total("total_carbs_g", "sum", "carbs_g"),
        Total("total_fat_g", "sum", "fat_g"),
        Total("total_fiber_g", "sum", "fiber_g"),
        Total("entry_count", "count"),
    ))


def weekly_workouts() -> PeriodTotals:
    return PeriodTotals("session_date", WEEK, "week_start", (
        Total("session_count", "count"),
        Total("total_duration_min", "sum", "duration_min"),
        Total("avg_duration_min", "mean", "duration_min", 1),
    ))


def weekly_cardio() -> PeriodTotals:
    return PeriodTotals("session_date", WEEK, "week_start", (
        Total("session_count", "count"),
        Total("total_km", "sum", "distance_km", 2),
        Total("total_min", "sum", "duration_min"),
        Total("total_steps", "sum", "steps"),
    ), ("activity_type",))


def weekly_sleep() -> PeriodTotals:
    return PeriodTotals("session_date", WEEK, "week_start", (
        Total("nights", "count"),
        Total("avg_sleep_min", "mean", "duration_min", 0),
        Total("avg_deep_min", "mean", "deep_min", 0),
        Total("avg_rem_min", "mean", "rem_min", 0),
        Total("avg_efficiency", "mean", "efficiency_pct", 1),
        Total("avg_sleep_score", "mean", "sleep_score", 1),
    ))


def stream_period_totals(
    rows: DataFrame,
    spec: PeriodTotals,
    store: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = ("user_id",),
    compact_every: int | None = 64,
    **trigger,
) -> StreamingQuery:
    """Totals per (keys, period), kept as partial sums that are added when they are read.

    Each batch stores the sums and counts of its own rows and reads nothing it stored before, so
    its cost follows its rows however long the history is, and a row counts however late it comes.
    A replay overwrites the batch's own folder. After every ``compact_every`` batches the stored
    sums are added up into one set (never, if None; see ``compact_totals``).
    """

    def total(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("_period", spec.period(F.col(spec.at))).drop(
            *([spec.name] if spec.name in batch.columns else [])).withColumnRenamed("_period", spec.name)
        partial = [c for t in spec.totals for c in t.partials()]
        write_batch(placed.groupBy(*spec.by(keys)).agg(*partial), store, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_totals(batch.sparkSession, store, spec, keys)

    return (
        rows.writeStream.foreachBatch(total)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact_totals(
    spark: SparkSession, store: str, spec: PeriodTotals, keys: Sequence[str] = ("user_id",)
) -> int:
    """Add the stored sums up into one set of rows, which readers take in place of the batches."""
    return compact(spark, store, lambda stored: spec.merged(stored, keys))


def period_totals(
    spark: SparkSession, store: str, spec: PeriodTotals, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    base, stored = read_since(spark, store)
    stored = stored.drop("batch")
    if base is not None:
        stored = stored.unionByName(base)
    return spec.merged(stored, keys).select(*spec.by(keys), *[t.result() for t in spec.totals])
