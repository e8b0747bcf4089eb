"""Exact dedup against a persistent digest index.

The index is a bucketed table sorted by digest, one row per distinct text. A batch is reduced to one
row per digest (map-side combine first), anti-joined with the index by sort-merge, and what is new is
appended. Text never travels: only 32-byte digests do.

Defined results: null text counts as empty; empty texts are copies of each other; ties on length go
to the smallest id; a row repeated with the same id counts in the group's size and shares the decision
of its id; a row without an id stays only where its text has no other row with one; very long texts are digested whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, hot_join, remove, scratch_path, staged

#: Characters that never count in a comparison.
BLANKS = r"[\x20\x09-\x0D]"
#: Rows that one bucket of a fresh index is made for.
BUCKET_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, chars of every row; the text itself goes no further."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"),
    )


class DigestIndex:
    """Distinct digests with the id that stands for each, kept at ``location`` between runs.

    ``buckets`` counts when the index is made; later runs find it in the table.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.table = "digest_index_" + hashlib.md5(location.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, keep_chars BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.location)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch of documents and append its new digests."""
        return self.add_digests(staged(digests(docs, id_col, text_col), "digests"))

    def add_digests(self, batch: DataFrame) -> DataFrame:
        """The same for a stored table of :func:`digests`.

        Returns one row per batch row: doc_id, digest, keep_id, group_size (rows of the batch), kept.
        A digest that the index already has keeps the indexed id; of new ones the row with the most code
        points, then the smallest id, stays.
        """
        groups = staged(
            batch.groupBy("digest").agg(
                F.max(F.struct("chars", (-F.col("doc_id")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("group_size")
            ),
            "groups",
        )
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", (-F.col("best.neg")).alias("keep_id"), F.col("best.chars").alias("keep_chars"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        resolved = staged(groups.join(self.rows().select("digest", "keep_id").hint("merge"), "digest").select("digest", "keep_id", "group_size"), "resolved")
        drop_staged(groups)
        decided = hot_join(batch, resolved, "digest", "group_size", batch.count(), F.col("doc_id"))
        return decided.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decisions for one table against a fresh index, with as many buckets as its rows need."""
    spark = docs.sparkSession
    batch = staged(digests(docs, id_col, text_col), "digests")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-batch.count() // BUCKET_ROWS))
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)
    out = index.add_digests(batch)
    index.drop()
    return out
