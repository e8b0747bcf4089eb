"""A training-data pipeline of five stages, each on what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. Filtering stages keep every column of ``documents``.

Defined results: a document without an id is rejected by the first stage, since no decision could name it; null and empty
texts are judged like others (all empty texts are copies of each other); rows repeated with id and text leave the exact
stage once; rows that share an id but not a text share every later decision; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from quarry.llm.common import scratch_scope, staged
from quarry.llm.queries import word_vocabulary


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is listed, with all their columns."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select_good(docs.filter("doc_id is not null"), model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each text stays."""
    kept = exact_dedup.deduplicate(docs).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_text_digest")).distinct()
    marked = docs.withColumn("_text_digest", exact_dedup.digest(F.col("text")))
    named = [F.col("_kept_id") == F.col("doc_id").cast("long"), marked["_text_digest"] == kept["_text_digest"]]
    return marked.join(kept, named, "left_semi").dropDuplicates(["doc_id", "_text_digest"]).select(docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: the smallest id of each stays."""
    return _only(docs, near_dedup.classes(docs).filter("kept"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark window go."""
    return _only(docs, decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: ids of every remaining text, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, word_vocabulary(), with_ids=True, with_text=False)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_representatives),
    ("decontaminate", keep_uncontaminated),
    ("bpe", tokenise),
]

#: Learned scores and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; of what they write, only the last table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_scope(spark) as kept:
        for name, stage in STAGES:
            with scratch_scope(spark) as handed_on:
                docs = handed_on(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        return kept(docs)
