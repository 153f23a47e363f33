"""Content flags counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalspark.operators.changes import FLAGS_TO_HIDE
from vitalspark.streaming.store import compact_latest, keep_state_on_disk, read_latest, write_batch

KEY = ["target_type", "target_id"]


def stream_flag_threshold(
    flags: DataFrame, store: str, checkpoint: str, *, compact_every: int | None = 64, **trigger
) -> StreamingQuery:
    """Running number of flags per target; each batch stores the totals it changed.

    Counts are combined before the shuffle, so a target with a third of all flags is
    one row per task. After every ``compact_every`` batches the stored totals are reduced to one
    row per target (never, if None).
    """

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, store, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_latest(batch.sparkSession, store, KEY)

    keep_state_on_disk(flags.sparkSession)
    totals = flags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"))
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def flag_totals(spark: SparkSession, store: str) -> DataFrame:
    return read_latest(spark, store, KEY).select(*KEY, "total")


def set_flag_counts(base: DataFrame, totals: DataFrame, target_type: str) -> DataFrame:
    """Base table with flag counts set to base plus running total; three hide a row.

    Setting instead of adding keeps a repeated batch harmless.
    """
    mine = totals.filter(F.col("target_type") == target_type).select(
        F.col("target_id").alias("_target"), F.col("total").cast("int").alias("_total")
    )
    count = F.col("flag_count") + F.col("_total")
    hit = F.col("_total").isNotNull()
    return (
        base.join(mine, F.col("id") == F.col("_target"), "left")
        .withColumns({
            "is_flagged": F.when(hit & (count >= FLAGS_TO_HIDE), F.lit(True)).otherwise(F.col("is_flagged")),
            "flag_count": F.when(hit, count).otherwise(F.col("flag_count")),
        })
        .drop("_target", "_total")
    )
