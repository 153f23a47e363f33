"""Chunks of documents in a bucketed scratch table, so that answers come to texts, not texts to answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import body_columns
from vitalspark.session import work_dir


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def chunked(docs: DataFrame, purpose: str, chunk_bytes: int,
            carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``chunk, row, doc_id, text`` and the ``carry`` columns as ``carry_0`` and so on, in ascending ``doc_id`` order, and the number of chunks.

    A chunk is one range of ids and about ``chunk_bytes`` of text; ``row`` numbers the documents
    upwards over all chunks. Rows of one id are ordered by text, rows without an id come first.
    The table is bucketed by ``chunk``, so a cogroup by it shuffles only the other side.
    """
    spark = docs.sparkSession
    texts = docs.select(*body_columns(), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    count = max(1, -(-text_bytes(texts) // chunk_bytes))
    table = f"{purpose}_{uuid.uuid4().hex}"
    (texts.repartitionByRange(count, "doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", F.xxhash64("text"))
     .select(F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("row"),
             "doc_id", "text", *[f"carry_{k}" for k in range(len(carry))])
     .write.format("parquet").option("compression", "zstd").option("path", work_dir(spark, purpose))
     .bucketBy(count, "chunk").saveAsTable(table))
    return spark.table(table), count
