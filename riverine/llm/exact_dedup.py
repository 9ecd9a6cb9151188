"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests a bucket of a new index takes of its first batch, at most; and the fewest buckets.
DIGESTS_PER_BUCKET, LEAST_BUCKETS = 5_000_000, 64


def normalised_digest(text: str | F.Column) -> F.Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest, that outlives the session.

    A batch of digests is deduplicated within itself; a sort-merge anti-join with the index, whose buckets need no
    shuffle, finds those that are new, and they are appended. Verdicts are then read from the index, so that a batch
    that runs again, after a crash at any point, gets the verdicts it had. Give buckets for an index that will outgrow
    its first batch; without, they follow that batch's size.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets

    @classmethod
    def temporary(cls, spark: SparkSession) -> DigestIndex:
        """An index of a new name, for one run; drop it afterwards."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, groups: DataFrame) -> DataFrame:
        """Appends those of groups (digest, keep_id; a written table) whose digest is new; returns the index's rows of all of them."""
        if not self.exists():
            self.buckets = self.buckets or max(LEAST_BUCKETS, -(-groups.count() // DIGESTS_PER_BUCKET))
            self._append(groups.limit(0))
        else:
            stated = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(stated["data_type"]) if stated else self.buckets or LEAST_BUCKETS
        index = self.read().hint("merge")
        new = written(groups.join(index, "digest", "left_anti"), "new-digests")
        self._append(new)
        return self.read().join(groups.select("digest").hint("merge"), "digest", "left_semi")

    def _append(self, groups: DataFrame) -> None:
        by_bucket = groups.select("digest", "keep_id").repartition(self.buckets, "digest")
        by_bucket.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; a written table.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and texts of any length are
    digested whole. Of equal texts in a batch the largest id stays, unless the index knows the text from an earlier
    batch: then keep_id is the id kept there, and only that document stays. So a batch that runs again gets the same
    verdicts. Rows that repeat an id and a text are one document and share their verdict; a null id never stays beside
    another. group_size counts rows of this batch. Other columns, whatever their names, are neither read nor returned.
    An empty table gives no rows.
    """
    digests = written(docs.select(F.col(id_col).alias("doc_id"), normalised_digest(docs[text_col]).alias("digest")), "digests")
    groups = written(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    # written, so that the join deals out both of its sides and Spark can split a frequent digest
    verdicts = written(index.add(groups).join(groups.select("digest", "group_size"), "digest"), "verdicts")
    judged = digests.join(verdicts, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    return written(judged, "judged")
