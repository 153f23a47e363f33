"""Exact deduplication with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import body, saved


def normalised(text):
    """Each run of space and 0x09-0x0D as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Documents are grouped by the 128-bit hash of the normalised text, from narrow fingerprint
    rows. Texts of groups with several rows are then compared byte by byte, so a collision
    splits its group. Copies meet in the map-side combine before any shuffle of texts.

    A null text is empty; all empty texts are one group. A null ``doc_id`` is never the
    smallest unless the whole group has none. Rows that repeat the kept id are all kept.
    An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
    """
    texts = body(docs).select("doc_id", normalised(F.col("text")).alias("body"))
    hashed = texts.select("doc_id", "body", F.unhex(F.md5(F.col("body").cast("binary"))).alias("h"))
    prints = saved(
        hashed.select("doc_id", "h", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")),
        "exact-prints")
    groups = prints.groupBy("h").agg(F.min("doc_id").alias("keep_id"),
                                     F.count(F.lit(1)).alias("group_size"))
    several = groups.filter("group_size > 1").select("h")
    members = saved(hashed.join(several, "h", "left_semi"), "exact-members")
    bodies = members.groupBy("h", "body").agg(F.min("doc_id").alias("keep_id"),
                                              F.count(F.lit(1)).alias("group_size"))
    collided = bodies.groupBy("h").count().filter("count > 1").select("h")
    alike = prints.join(collided, "h", "left_anti").join(groups, "h")
    split = (members.join(collided, "h", "left_semi").join(bodies, ["h", "body"])
             .withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256)))
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return (alike.select(*columns).unionByName(split.select(*columns))
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; of rows that repeat an id and its
    text one stays."""
    kept = exact_dedup(docs).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("row_id"),
                        F.sha2(normalised(whole).cast("binary"), 256).alias("row_sha"))
    same = named.row_id.eqNullSafe(kept.kept_id) & (named.row_sha == kept.kept_sha)
    one = Window.partitionBy("row_id", "row_sha").orderBy("row_id")
    return (named.join(kept, same, "left_semi").withColumn("place", F.row_number().over(one))
            .filter("place = 1").select("row.*"))
