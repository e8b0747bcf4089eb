"""A term and vector index that grows by segments.

A segment is immutable: postings, chunk lengths and vectors of new chunks, and the ids of chunks that it removes from earlier
segments. It becomes visible by one row of ``commits``, written last. Reading takes the segments since the last compaction and drops
rows whose chunk a later segment removed, so a refresh writes what changed and nothing else; a compaction writes the rows that live as
one segment. The index then equals one that is built anew from the chunks that are left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .retrieval import TermIndex, build_term_index

COMMIT_SCHEMA = "sequence long, segment string, compacted boolean, committed_at timestamp"


def plan_embeddings(plan: DataFrame, chunks: DataFrame, embeddings: DataFrame, model_version: str) -> DataFrame:
    """What to do with vectors: (chunk_id, model_version, action).

    ``plan`` is a refresh plan (chunk_id, action), ``chunks`` what the next generation holds (chunk_id), ``embeddings`` the stored vectors
    (chunk_id, model_version). A vector of a chunk that stays is reused where it is of the wanted version, else deleted; chunks without
    a vector of that version are to be embedded.
    """
    staying = chunks.select("chunk_id").distinct()
    gone = plan.filter("action = 'delete'").select("chunk_id").distinct()
    stored = embeddings.select("chunk_id", "model_version").distinct()
    kept = stored.join(staying, "chunk_id", "left_semi").join(gone, "chunk_id", "left_anti").filter(F.col("model_version") == model_version)
    reuse = kept.withColumn("action", F.lit("reuse"))
    drop = stored.join(kept, ["chunk_id", "model_version"], "left_anti").withColumn("action", F.lit("delete"))
    embed = staying.join(kept.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit(model_version).alias("model_version"), F.lit("embed").alias("action"))
    return reuse.unionByName(drop).unionByName(embed)


class SegmentedIndex:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list:
        """The live segments in order: since and with the last compaction. One short row a refresh."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return []
        rows = self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits").orderBy("sequence").collect()
        last = max((i for i, r in enumerate(rows) if r.compacted), default=0)
        return rows[last:]

    def _commit(self, segment: str, sequence: int, compacted: bool) -> None:
        row = self.spark.range(1).select(F.lit(sequence).cast("long").alias("sequence"), F.lit(segment).alias("segment"), F.lit(compacted).alias("compacted"), F.current_timestamp().alias("committed_at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _write(self, segment: str, sequence: int, index: TermIndex, vectors: DataFrame, removed: DataFrame) -> None:
        at = F.lit(sequence).cast("long").alias("sequence")
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # sorted by term, so that a search for some terms reads few row groups
        index.postings.repartition(width, "term").sortWithinPartitions("term").select("*", at).write.parquet(f"{segment}/postings")
        index.lengths.select("*", at).write.parquet(f"{segment}/lengths")
        vectors.select("chunk_id", "model_version", "vector", at).write.parquet(f"{segment}/vectors")
        removed.select("chunk_id", at).distinct().write.parquet(f"{segment}/removed")

    def refresh(self, added: DataFrame, removed: DataFrame, vectors: DataFrame | None = None) -> int:
        """Index new chunks (chunk_id, relative_path, text), forget removed ones (chunk_id), store new vectors. Returns the sequence number.

        A chunk may be removed and added in one refresh: the removal holds for earlier segments only. Vectors
        (chunk_id, model_version, vector) may be of chunks that are indexed already; one of the same chunk and version replaces the former.
        """
        live = self.commits()
        sequence = live[-1].sequence + 1 if live else 0
        segment = f"{self.path}/segments/{sequence:012d}-{uuid.uuid4().hex}"
        if vectors is None:
            vectors = added.select("chunk_id", F.lit("").alias("model_version"), F.array().cast("array<float>").alias("vector")).limit(0)
        self._write(segment, sequence, build_term_index(added), vectors, removed)
        self._commit(segment, sequence, False)
        return sequence

    def _rows(self, part: str, live: list) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{r.segment}/{part}" for r in live])
        removed = self.spark.read.parquet(*[f"{r.segment}/removed" for r in live]).groupBy("chunk_id").agg(F.max("sequence").alias("_removed"))
        # a tombstone of the same segment is older than the segment's own rows
        return rows.join(removed, [rows["chunk_id"] == removed["chunk_id"], rows["sequence"] < removed["_removed"]], "left_anti")

    def read(self) -> TermIndex:
        """Postings and lengths of the chunks that live."""
        live = self.commits()
        if not live:
            raise ValueError("nothing has been committed to this index")
        return TermIndex(self._rows("postings", live).drop("sequence"), self._rows("lengths", live).drop("sequence"))

    def vectors(self, model_version: str | None = None) -> DataFrame:
        """(chunk_id, model_version, vector) of the chunks that live, the latest of each version."""
        rows = self._rows("vectors", self.commits())
        rows = rows if model_version is None else rows.filter(F.col("model_version") == model_version)
        return rows.groupBy("chunk_id", "model_version").agg(F.max_by("vector", "sequence").alias("vector"))

    def compact(self) -> int:
        """Rewrite what lives as one segment; segments before it are read no more (see :meth:`drop_dead`)."""
        live = self.commits()
        sequence = live[-1].sequence + 1
        segment = f"{self.path}/segments/{sequence:012d}-{uuid.uuid4().hex}"
        index = self.read()
        self._write(segment, sequence, index, self.vectors(), index.lengths.select("chunk_id").limit(0))
        self._commit(segment, sequence, True)
        return sequence

    def drop_dead(self) -> None:
        """Delete segments that no reader of the current index needs; readers that began before a compaction must have ended."""
        alive = {r.segment for r in self.commits()}
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for row in self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits").select("segment").collect():
            if row.segment not in alive:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(row.segment), True)


def refresh_index(index: SegmentedIndex, plan: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> int:
    """Apply a refresh plan (repository_id, relative_path, chunk_id, action): deleted chunks go, those of re-chunked files come.

    ``chunks`` are the next generation's (chunk_id, repository_id, relative_path, text); only files that the plan re-chunks are read further.
    """
    plan = staged(plan, "plan")
    redone = plan.filter("action = 'rechunk'").select("repository_id", "relative_path").distinct()
    return index.refresh(chunks.join(redone, ["repository_id", "relative_path"], "left_semi"), plan.filter("action = 'delete'").select("chunk_id"), vectors)
