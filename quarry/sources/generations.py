"""Publishing generations as snapshots.

Every write goes to a place of its own, named by the attempt, and becomes visible by rows of ``generations`` that are written last and
name it. Nothing that a reader can see is ever overwritten: a failed or unfinished write leaves the former snapshot of a generation whole,
and a reader who has pinned the stamps keeps reading what they name. A generation that is published again is read
from its latest snapshot alone, so a table without rows replaces one with rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

PARTS = ("manifest", "chunks", "excluded")
KEY = ["repository_id", "generation_id"]
STAMP_SCHEMA = "repository_id string, generation_id string, created_at_ms long, snapshot string, published_at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """One row per published generation: when it was made, and its latest snapshot."""
    if not _exists(spark, f"{path}/generations"):
        return spark.createDataFrame([], STAMP_SCHEMA)
    latest = F.max_by(F.struct("created_at_ms", "snapshot", "published_at"), F.struct("published_at", "snapshot"))
    return spark.read.schema(STAMP_SCHEMA).parquet(f"{path}/generations").groupBy(*KEY).agg(latest.alias("s")).select(*KEY, "s.*")


def write_snapshot(path: str, snapshot: str, named: DataFrame, tables: tuple[DataFrame, ...]) -> None:
    """The rows of the named generations (repository_id, generation_id), unseen until they are published."""
    written = [(name, table.join(named, "repository_id")) for name, table in zip(PARTS, tables, strict=True)]
    for name, rows in written:
        rows.write.mode("overwrite").partitionBy(*KEY).parquet(f"{path}/{name}/snapshot={snapshot}")
    for name, rows in written:  # a table without rows has no file that tells its columns
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/schemas/{name}/snapshot={snapshot}")


def publish(path: str, snapshot: str, ready: DataFrame) -> None:
    """Make a snapshot the current one of these generations (repository_id, generation_id, created_at_ms); a second time changes nothing."""
    spark = ready.sparkSession
    rows = ready.select(*KEY, "created_at_ms").distinct()
    if _exists(spark, f"{path}/generations"):
        known = spark.read.schema(STAMP_SCHEMA).parquet(f"{path}/generations").filter(F.col("snapshot") == snapshot)
        rows = rows.join(known.select(*KEY), KEY, "left_anti")
    rows = staged(rows, "ready")
    if not rows.isEmpty():
        rows.withColumns({"snapshot": F.lit(snapshot), "published_at": F.current_timestamp()}).write.mode("append").parquet(f"{path}/generations")


def write_generations(path: str, stamps: DataFrame, manifest: DataFrame, chunks: DataFrame, excluded: DataFrame, published: DataFrame | None = None, attempt: str | None = None) -> str:
    """Write the rows of many repositories under their generations, one write a table, then publish. Returns the snapshot's name.

    ``stamps`` has repository_id, generation_id, created_at_ms, the three tables repository_id; ``published`` are the stamps to
    publish, all of them by default. A job that may be retried names its ``attempt``: once published, its files are not written
    again, and its stamps not twice.
    """
    spark = stamps.sparkSession
    snapshot = attempt or uuid.uuid4().hex
    stamps = staged(stamps.select(*KEY, "created_at_ms"), "stamps")
    done = _exists(spark, f"{path}/generations") and not spark.read.schema(STAMP_SCHEMA).parquet(f"{path}/generations").filter(F.col("snapshot") == snapshot).isEmpty()
    if not done:
        write_snapshot(path, snapshot, stamps.select(*KEY).distinct(), (manifest, chunks, excluded))
    publish(path, snapshot, stamps if published is None else published)
    return snapshot


def write_generation(path: str, repository_id: str, generation_id: str, created_at_ms: int, manifest: DataFrame, chunks: DataFrame, excluded: DataFrame, attempt: str | None = None) -> str:
    """The same for one repository whose tables do not name it."""
    stamp = manifest.sparkSession.range(1).select(F.lit(repository_id).alias("repository_id"), F.lit(generation_id).alias("generation_id"), F.lit(created_at_ms).cast("long").alias("created_at_ms"))
    named = [t.withColumn("repository_id", F.lit(repository_id)) for t in (manifest, chunks, excluded)]
    return write_generations(path, stamp, *named, attempt=attempt)


def pin(spark: SparkSession, path: str) -> DataFrame:
    """The stamps as they are now; what is read with them stays the same however often generations are published later."""
    return staged(stamps(spark, path), "pinned")


def read_generation(spark: SparkSession, path: str, part: str, pinned: DataFrame | None = None) -> DataFrame:
    """Rows of published generations only, each from its current (or pinned) snapshot."""
    wanted = (stamps(spark, path) if pinned is None else pinned).select(*KEY, "snapshot")
    known = spark.read.option("mergeSchema", "true").parquet(f"{path}/schemas/{part}").drop("snapshot", *KEY).schema.fields
    columns = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in known] + ["snapshot string", *[f"{k} string" for k in KEY]])
    rows = spark.read.schema(columns).parquet(f"{path}/{part}")
    return rows.join(wanted, [*KEY, "snapshot"], "left_semi").drop("snapshot")


def summary_json(summary: DataFrame) -> DataFrame:
    """One JSON object per row, fields in column order."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("summary"))


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
