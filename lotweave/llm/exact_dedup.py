"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per text ever kept. New rows are first
reduced to one row per digest (partial aggregation runs before the shuffle, so a text with any
number of copies sends one row per task), then a sort-merge anti-join against the index, which
needs no shuffle on the index side, leaves the digests that are new, and those are appended.
Everything is DataFrame work; texts never enter a shuffle before the last semi-join of ``dedup``.

Defined results. A null text counts as the empty text, and all empty texts are copies of each other.
Ties in length go to the smallest doc_id, a null doc_id comes last. Rows that repeat both doc_id and
text have equal rank: ``decide`` gives each of them a row, ``dedup`` leaves one. Extra columns are
carried by ``dedup`` and ignored by ``decide``; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.common import lookup, same

SPACE = " \t\n\x0b\f\r"
#: Buckets of a new index; choose about one per 256 MB that the index will hold.
BUCKETS = 64


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) of the normalised text, points (code points of the original text)."""
    return docs.select("doc_id", F.unhex(F.sha2(normal_text(F.col("text")).cast("binary"), 256)).alias("digest"),
                       F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))


def _best() -> Column:
    """Longest first, then the smallest id, null last."""
    return F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))


class DigestIndex:
    """A digest table that outlives the job: ``digest, keep_id, points, group_size``."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], "digest binary, keep_id bigint, points bigint, group_size bigint")
            self._append(empty, buckets)
        self.buckets = buckets

    def _append(self, rows: DataFrame, buckets: int) -> None:
        # one task per bucket, so that a bucket gets one sorted file per batch
        (rows.repartition(buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (from ``digests``) that the index lacks, each with its best row.

        A digest that an earlier batch brought keeps that batch's row, so a batch that is added
        again changes nothing.
        """
        best = batch.groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        best = best.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("points"), "group_size")
        new = best.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        self._append(new, self.buckets)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def decide(docs: DataFrame, table: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``table`` names a lasting index; without it the index is made for this call alone.
    ``group_size`` counts the rows of the batch that brought the digest.
    """
    index = DigestIndex(docs.sparkSession, table or f"digests_{uuid.uuid4().hex}")
    rows = digests(docs)
    index.add(rows)
    groups = index.rows()
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    found = lookup(rows, groups, ["digest"], ["keep_id", "group_size"], "group_size", total)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, table: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; the texts are shuffled once."""
    index = DigestIndex(docs.sparkSession, table or f"digests_{uuid.uuid4().hex}")
    index.add(digests(docs))
    keep = index.rows().select("digest", F.col("keep_id").alias("keep"), "points")
    # the row travels in one struct, so that no column of the documents meets a name used here
    marked = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(normal_text(F.col("text")).cast("binary"), 256)).alias("digest"),
                         F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), F.col("doc_id").alias("keep"))
    keys = ["digest", "keep", "points"]
    best = marked.join(keep, same(marked, keep, keys), "left_semi")
    # rows that repeat the kept row's id and text
    return best.dropDuplicates(keys).select("row.*")
