"""Deterministic manifests, generation ids, diffs and refresh plans. Only paths and hashes are shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Versions

FILE = ["repository_id", "relative_path"]


def build_manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per file (with content_hash, size_bytes, language): chunk ids in document order, empty where there are none."""
    ids = chunks.groupBy(*FILE).agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return files.select(*FILE, "content_hash", "size_bytes", "language").join(ids, FILE, "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def _hashed_in_order(versions: Versions):
    tail = "".join("\0" + v for v in (versions.chunker, versions.parser, versions.embedding))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, digest, n = False, None, None, 0

        def row():
            known = None if now is None else digest.hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([known], pa.string()), pa.array([n], pa.int32())], names=["repository_id", "generation_id", "n_files"])

        for batch in batches:
            for repository, path, content in zip(*(batch.column(c).to_pylist() for c in ("repository_id", "relative_path", "content_hash")), strict=True):
                if not started or repository != now:
                    if started:
                        yield row()
                    started, now, digest, n = True, repository, hashlib.sha256(((repository or "") + tail).encode()), 0
                n += 1
                if path is not None and content is not None:
                    digest.update(f"\0{path}\0{content}".encode())
        if started:
            yield row()

    return run


def generation_ids(manifest: DataFrame, versions: Versions = Versions()) -> DataFrame:
    """(repository_id, generation_id, n_files): first 32 hex digits of a hash over repository, versions and the sorted (path, hash) pairs.

    A repository's pairs are sorted in one task, which may spill, and hashed as they stream by, so memory does not grow with their number.
    """
    pairs = manifest.select("repository_id", "relative_path", "content_hash")
    ordered = pairs.repartition("repository_id").sortWithinPartitions("repository_id", "relative_path", "content_hash")
    return ordered.mapInArrow(_hashed_in_order(versions), "repository_id string, generation_id string, n_files int")


def diff_manifests(previous: DataFrame, following: DataFrame) -> DataFrame:
    """(repository_id, relative_path, change): added, modified, removed or unchanged."""
    old = previous.select(*FILE, F.col("content_hash").alias("old_hash"))
    new = following.select(*FILE, F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return old.join(new, FILE, "full").select(*FILE, change.alias("change"))


def plan_refresh(diff: DataFrame, chunks: DataFrame, same_versions: bool | DataFrame = True) -> DataFrame:
    """What to do with files and with existing chunks: (repository_id, relative_path, chunk_id, action).

    Added and modified files are re-chunked, chunks of unchanged files reused, all others deleted; a change of any
    version voids reuse, in all repositories or in those that ``same_versions`` (repository_id, same) says. ``chunks`` are read once.
    """
    if isinstance(same_versions, DataFrame):
        known = same_versions.groupBy("repository_id").agg(F.min("same").alias("_same"))
        diff = diff.join(known, "repository_id", "left").withColumn("_same", F.coalesce("_same", F.lit(False)))
    else:
        diff = diff.withColumn("_same", F.lit(same_versions))
    usable = (F.col("change") == "unchanged") & F.col("_same")
    work = diff.filter((F.col("change") != "removed") & ~usable).select(*FILE, F.lit(None).cast("string").alias("chunk_id"), F.lit("rechunk").alias("action"))
    kept = diff.filter(usable).select(*FILE).distinct().withColumn("_kept", F.lit(True))
    known = chunks.join(kept, FILE, "left").select(*FILE, "chunk_id", F.when(F.col("_kept"), "reuse").otherwise("delete").alias("action"))
    return work.unionByName(known)


def retained_generations(generations: DataFrame, references: DataFrame) -> DataFrame:
    """The latest generation of each repository and those that a session refers to."""
    current = generations.groupBy("repository_id").agg(F.max_by("generation_id", F.struct("created_at_ms", "generation_id")).alias("generation_id"))
    used = generations.join(references.select("generation_id").distinct(), "generation_id", "left_semi").select("repository_id", "generation_id")
    return current.unionByName(used).distinct()


def chunk_references(manifests: DataFrame, retained: DataFrame) -> DataFrame:
    """Mark: (chunk_id, n_references), how many retained manifests (repository_id, generation_id, chunk_ids) list each chunk."""
    listed = manifests.join(retained, ["repository_id", "generation_id"], "left_semi").select("repository_id", "generation_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    return listed.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_references"))


def sweep(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """(chunk_id, n_references, action): stored chunks that nothing refers to are dropped, the others kept."""
    counted = chunks.select("chunk_id").distinct().join(references, "chunk_id", "left")
    n = F.coalesce("n_references", F.lit(0))
    return counted.select("chunk_id", n.alias("n_references"), F.when(n > 0, "keep").otherwise("drop").alias("action"))


def retained_chunks(chunks: DataFrame, manifests: DataFrame, retained: DataFrame) -> DataFrame:
    """Chunks that some retained manifest (repository_id, generation_id, chunk_ids) lists."""
    listed = manifests.join(retained, ["repository_id", "generation_id"], "left_semi").select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return chunks.join(listed, "chunk_id", "left_semi")


def check_determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per repository whether two runs of the same content gave the same id."""
    a = first.select("repository_id", F.col("generation_id").alias("first_id"))
    b = second.select("repository_id", F.col("generation_id").alias("second_id"))
    return a.join(b, "repository_id", "full").select("repository_id", F.col("first_id").eqNullSafe(F.col("second_id")).alias("same"))
