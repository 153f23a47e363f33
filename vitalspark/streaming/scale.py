"""Scale readings loaded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitalspark.operators.changes import insert_if_absent
from vitalspark.sources.scale import read_scale_measurements, reading_columns
from vitalspark.streaming.store import read_store, write_batch

KEY = ["renpho_user_id", "measured_at"]


def stream_scale_measurements(
    lines: DataFrame,
    store: str,
    checkpoint: str,
    as_of,
    *,
    base: DataFrame | None = None,
    rejects: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Load JSON readings (``value``, ``renpho_user_id``, ``arrival``) exactly once per key.

    Each batch is compared with what earlier batches stored and with ``base``; any
    lateness is accepted. Only keys are read back, and only for the days in the batch.
    """
    measured = read_scale_measurements(
        reading_columns(lines), as_of, "renpho_user_id", "arrival"
    ).withColumn("source", F.lit("renpho"))
    schema = T.StructType([f for f in measured.schema.fields if f.name != "rejected_field"])
    own = F.col("source") == "renpho"

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            store_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good = batch.filter(F.col("rejected_field").isNull()).drop("rejected_field")
        if batch_id > 0:
            stored = read_store(spark, store, schema).filter(F.col("batch") < batch_id)
        else:
            stored = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
        known = stored.select(*KEY, "source")
        if base is not None:
            known = known.unionByName(base.select(*KEY, "source"))
        days = good.select("measured_at").agg(F.min("measured_at"), F.max("measured_at")).first()
        if days[0] is not None:
            known = known.filter(F.col("measured_at").between(F.lit(days[0]), F.lit(days[1])))
        write_batch(insert_if_absent(known, good, KEY, where=own).applied, store, batch_id)
        if rejects is not None:
            write_batch(batch.filter(F.col("rejected_field").isNotNull()), rejects, batch_id)

    return (
        measured.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def loaded_measurements(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).drop("batch")


def stream_scale_bounded(
    lines: DataFrame, store: str, checkpoint: str, as_of, delay: str = "2 days", **trigger
) -> StreamingQuery:
    """Readings exactly once per (scale user, time), with bounded state and none lost.

    Rows within ``delay`` of the newest reading are told apart by Spark's own state, which forgets
    keys as the watermark passes them, so they need no look at the store. What that state does not
    let through is either a repeat or late; those rows are compared with the keys stored for
    their own days. Of equal keys the first batch counts, within a batch the first arrival. Rows
    without a scale user never repeat one another.

    Each batch is stored by day; a replay overwrites its own folder.
    """
    measured = read_scale_measurements(
        reading_columns(lines), as_of, "renpho_user_id", "arrival"
    ).filter(F.col("rejected_field").isNull()).drop("rejected_field")
    schema = measured.schema
    fresh = (
        measured.withWatermark("measured_at", delay).filter(F.col("renpho_user_id").isNotNull())
        .dropDuplicatesWithinWatermark(KEY).select(*KEY, F.lit(True).alias("_fresh"))
    )
    both = measured.withColumn("_fresh", F.lit(False)).unionByName(fresh, allowMissingColumns=True)

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            store_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        owned = F.col("renpho_user_id").isNotNull()
        # a key that the state let through comes before its rows, the first of which is then the second
        order = Window.partitionBy(*KEY).orderBy(F.col("_fresh").desc(), "arrival")
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = (
            batch.filter(owned)
            .withColumns({"_place": F.row_number().over(order), "_passed": F.max("_fresh").over(so_far)})
            .filter((F.col("_place") <= 2) & ~F.col("_fresh") & ((F.col("_place") == 1) | F.col("_passed")))
            .drop("_place", "_fresh")
        )
        rest = first.filter(~F.col("_passed")).drop("_passed")
        # the days of late rows and repeats; a calendar has few
        days = [r[0] for r in rest.select("measurement_date").distinct().collect()]
        if batch_id > 0 and days:
            stored = read_store(spark, store, schema).filter(
                (F.col("batch") < batch_id) & F.col("measurement_date").isin(days))
            rest = rest.join(stored.select(*KEY), KEY, "left_anti")
        new = (
            first.filter("_passed").drop("_passed").unionByName(rest)
            .unionByName(batch.filter(~owned & ~F.col("_fresh")).drop("_fresh"))
        )
        new.repartition("measurement_date").write.mode("overwrite").partitionBy("measurement_date").parquet(
            f"{store.rstrip('/')}/batch={batch_id}")

    return (
        both.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
