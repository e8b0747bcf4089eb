"""Counts, summaries and samples over dispositions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .discovery import UNREADABLE, UNREADABLE_FILE


def skipped_by_origin(dispositions: DataFrame) -> DataFrame:
    return dispositions.filter("status = 'skipped'").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def indexed_by_language(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def corpus_summary(files: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per repository from file statuses (``truncated`` where the listing was cut) and per-file chunk totals."""
    joined = files.join(totals, ["repository_id", "relative_path"], "left")
    count = lambda status: F.count_if(F.col("status") == status)
    return joined.groupBy("repository_id").agg(
        count("indexed").alias("indexed"), count("skipped").alias("skipped"), count("binary").alias("unreadable"), count("minified").alias("minified"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.max(F.col("truncated").isNotNull()).alias("truncated"),
    )


def top_counts(counts: DataFrame, key: str, n: int = 15) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(n)


def sample_rows(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.orderBy("repository_id", "relative_path").limit(n)


def coverage(dispositions: DataFrame) -> DataFrame:
    """Files seen, indexed and excluded by reason; ``complete`` only where nothing was cut off and everything could be read."""
    lost = (F.col("origin") == "boundary") & F.col("reason").isin(UNREADABLE, UNREADABLE_FILE)
    per = dispositions.groupBy("repository_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("truncated").isNotNull() | F.coalesce(lost, F.lit(False))).alias("cut"))
    return per.groupBy("repository_id").agg(
        F.sum("n").alias("seen"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("indexed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))), lambda x: F.concat_ws("=", x["reason"], x["n"].cast("string"))), ";").alias("excluded"),
        (~F.max("cut")).alias("complete"),
    )
