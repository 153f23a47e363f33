"""Token ids as Parquet lists: dictionary pages for ids, delta pages for positions, page indexes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import blocks, body, map_arrow, utf8
from vitalspark.llm.words import encoder

#: Row group and page sizes in bytes, and rows a page at most: what one selective read costs.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = "part int, doc_id long, file_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every whole text and write the ids in ascending ``doc_id`` order.

    File ``part`` k holds the k-th range of ids; ``file_start`` counts the ids before a document
    in its file. Rows with one ``doc_id`` are ordered by text, rows without an id come first. A
    null or empty text has the end id alone.
    """
    ordered = (body(docs).repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", "text"))

    def encode(batches):
        words, part, before = encoder(tokenizer, True), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(offsets, 4 << 20):
                ids = [words.encode(t) + end for t in batch.column("text")[lo:hi].to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, part, np.int32)), batch.column("doc_id")[lo:hi],
                     pa.array(before + ends - n), pa.array(n), lists],
                    ["part", "doc_id", "file_start", "n_tokens", "ids"])
                before += int(n.sum())

    ordered.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on ``doc_id`` reach the page indexes, and ids are read only if asked for."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the metadata columns alone: ``doc_id, part, start, n_tokens``."""
    rows = read_tokens(spark, path).select("part", "doc_id", "file_start", "n_tokens")
    return rows.join(_starts(rows), "part").select(
        "doc_id", "part", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens")


def _starts(rows: DataFrame) -> DataFrame:
    """Ids before each file: one row per file."""
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` of every document."""

    def digest(batch: pa.RecordBatch):
        ids = batch.column("ids")
        o = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("part", "doc_id", "file_start")),
             pa.array(np.diff(o).astype(np.int64)), pa.array(crc, pa.int64())],
            ["part", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    found = map_arrow(rows.select("part", "doc_id", "file_start", "ids"), digest,
                      "part int, doc_id long, file_start long, n_tokens long, ids_crc32 long")
    return found.join(_starts(rows.select("part", "n_tokens")), "part").select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
