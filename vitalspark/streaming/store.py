"""Result stores of streams: one folder per micro-batch, overwritten on replay."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitalspark.skew import first_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State in RocksDB: keys need not fit in executor memory, and timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batch(df: DataFrame, store: str, batch_id: int) -> None:
    """A batch always writes its own folder whole, so a replay changes nothing."""
    df.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch_id}")


def read_store(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(store)


def bases(spark: SparkSession, store: str) -> tuple[str, int]:
    """Where a store's compacted rows are, and the last batch they cover (-1: none)."""
    folder = f"{store.rstrip('/')}-base"
    try:
        upto = spark.read.parquet(folder).select(F.max("upto")).first()[0]
    except AnalysisException:  # never compacted
        upto = None
    return folder, -1 if upto is None else upto


def read_since(spark: SparkSession, store: str) -> tuple[DataFrame | None, DataFrame]:
    """The newest compacted rows, if any, and the rows of the batches after them, with ``batch``."""
    folder, upto = bases(spark, store)
    rows = spark.read.parquet(store).filter(F.col("batch") > upto)
    if upto < 0:
        return None, rows
    return spark.read.parquet(folder).filter(F.col("upto") == upto).drop("upto"), rows


def compact(spark: SparkSession, store: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Merge all stored batches into one set of rows, which readers take in their place.

    ``merge`` reduces stored rows and must give the same over rows it has merged already. Stop
    the stream, or call this from its own batches. Returns the last batch covered. Batch folders
    up to there, and older ``upto`` folders, are never read again and may be deleted.
    """
    base, rows = read_since(spark, store)
    newest = rows.select(F.max("batch")).first()[0]
    folder, upto = bases(spark, store)
    if newest is None:
        return upto
    both = rows if base is None else rows.unionByName(base.withColumn("batch", F.lit(upto)))
    merge(both).write.mode("overwrite").parquet(f"{folder}/upto={newest}")
    return newest


def read_latest(spark: SparkSession, store: str, keys: Sequence[str]) -> DataFrame:
    """The newest stored row of each key, over compacted rows and later batches."""
    base, rows = read_since(spark, store)
    if base is not None:
        rows = rows.unionByName(base.withColumn("batch", F.lit(-1).cast("int")))
    return latest_state(rows, keys).drop("batch")


def compact_latest(spark: SparkSession, store: str, keys: Sequence[str]) -> int:
    return compact(spark, store, lambda rows: latest_state(rows, keys).drop("batch"))


def latest_state(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest stored row of each key."""
    return first_rows(rows, keys, [F.col("batch").desc()])


def finish(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query; a failure is raised here."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
