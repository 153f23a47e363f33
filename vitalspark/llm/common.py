"""What the corpus operators share: scratch tables, Arrow text access and vectorised words.

Texts are handled as UTF-8 bytes in numpy. A word is a run of bytes other than space and
0x09-0x0D. Hashes are 64-bit polynomials over random byte values, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalspark.session import work_dir

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
BLOCK_BYTES = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def saved(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back: a cut of the lineage."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def body(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and the text, null as empty; other columns play no part."""
    return docs.select(*body_columns())


def body_columns() -> list[Column]:
    return [F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those whose hash of ``key`` is smallest.

    What surely lies beyond the bound is filtered out first, so no task sends many rows.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > rows:
        share = min(1.0, (rows + 6 * rows ** 0.5 + 10) / total)
        df = df.filter(h < int(share * (1 << 40)))
    return df.orderBy(h, key, *[c for c in df.columns if c != key]).limit(rows)


def release() -> None:
    """Let the driver forget finished frames, so that Spark's cleaner drops their shuffle files."""
    import gc

    from pyspark.sql import SparkSession

    gc.collect()
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """Apply ``make`` to record batches; it may be a generator."""

    def run(batches):
        for batch in batches:
            yield from make(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)
    o = o[column.offset:column.offset + len(column) + 1].astype(np.int64)
    d = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES,
           rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and ``limit`` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below ``n``; only tables of ordinary blocks are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 2)
        have = np.empty(size, np.uint64)
        have[0], k = 1, 1
        while k < size:
            m = min(k, size - k)
            have[k:k + m] = have[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times power of the base; ``span_hash`` reads any span from them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    raw = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts]
    return mix(raw + np.uint64(0x9E3779B97F4A7C15) * (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; runs end at row offsets."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before &= ~cut[:-1]
    after &= ~cut[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def windows(word_hash: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words and its first word; runs stay within a row."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ word_hash[j:n - k + 1 + j]) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(j + 1)
    last = np.repeat(bounds[1:], np.diff(bounds))[:n - k + 1]
    first = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mix(h[first]), first


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
