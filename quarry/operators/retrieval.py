"""Scoped retrieval: a stored term index, exact, lexical and vector search, fusion, evidence packs.

The index is written once per generation and read by every search: postings bucketed and sorted by term, one row per term
and chunk with the frequency in each field, and one row per chunk with its lengths. A search filters the postings by the
terms that are asked for before anything is joined or counted.

Parameters that no source fixes are this library's: k1 = 1.2, b = 0.75, field weights 2 : 1, fusion constant 60,
documentation penalty 0.5, evidence budget 10,000 tokens and 12 items.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import path_segments
from ..functions.text import query_terms
from ..session import staged
from .postings import best_hits, lengths_of, postings_of

K1, B, ORIGINAL_WEIGHT, SPLIT_WEIGHT, FUSION = 1.2, 0.75, 2.0, 1.0, 60
#: Bytes of the cosine matrix that a cell makes at a time; queries and vectors of a block, about.
TILE_BYTES, QUERY_BLOCK, VECTOR_BLOCK = 1 << 25, 4_096, 16_384
#: Rows that a task sorts where their number decides how many tasks there are.
ROWS_PER_TASK = 1 << 19


def scope_chunks(chunks: DataFrame, generations: DataFrame, repository_id: str, generation_id: str) -> DataFrame:
    """Chunks of one published generation; an unpublished one gives nothing."""
    wanted = generations.filter((F.col("repository_id") == repository_id) & (F.col("generation_id") == generation_id)).select("repository_id", "generation_id")
    scoped = chunks.filter((F.col("repository_id") == repository_id) & (F.col("generation_id") == generation_id))
    return scoped.join(wanted, ["repository_id", "generation_id"], "left_semi")


@dataclass(frozen=True)
class TermIndex:
    """Postings (term, chunk_id, original, split, path: frequencies by field) and lengths (chunk_id, original, split)."""

    postings: DataFrame
    lengths: DataFrame


def build_term_index(chunks: DataFrame) -> TermIndex:
    """Terms of (chunk_id, relative_path, text): identifiers as written, their split forms, and path segments; a null text or path has none."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    chunks = chunks.select("chunk_id", empty("relative_path"), empty("text"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    segments = F.transform(path_segments(F.col("relative_path")), F.lower).alias("segments")
    found = chunks.select("chunk_id", "text", segments).mapInArrow(postings_of, f"term string, chunk_id {kind}, original long, split long, path long")
    if not chunks.groupBy("chunk_id").count().filter("count > 1").isEmpty():  # rows of one id are one chunk
        found = found.groupBy("term", "chunk_id").agg(*[F.sum(f).alias(f) for f in ("original", "split", "path")])
    return TermIndex(found, chunks.select("chunk_id", "text").mapInArrow(lengths_of, f"chunk_id {kind}, original int, split int"))


def write_term_index(index: TermIndex, path: str, buckets: int) -> None:
    """Store an index under ``path``; postings are bucketed and sorted by term, so a search joins them without a shuffle of theirs."""
    name = _table_of(path)
    index.postings.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    index.postings.repartition(buckets, "term").write.bucketBy(buckets, "term").sortBy("term").option("path", f"{path}/postings").saveAsTable(name)
    index.lengths.write.parquet(f"{path}/lengths")


def read_term_index(spark: SparkSession, path: str, buckets: int | None = None) -> TermIndex:
    """An index under ``path``; one that another application wrote is made known to this one's catalog, for which its ``buckets`` are needed."""
    name = _table_of(path)
    if buckets is not None and not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/postings").schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
    return TermIndex(spark.table(name), spark.read.parquet(f"{path}/lengths"))


def _table_of(path: str) -> str:
    return "term_index_" + hashlib.md5(path.encode()).hexdigest()[:16]


def content_key(chunks: DataFrame) -> str:
    """A key of all (chunk_id, relative_path, text) rows in any order: count, sum and exclusive or of 64-bit row hashes. One scan, one row to the driver."""
    row = lambda seed: F.xxhash64(F.lit(seed), "chunk_id", "relative_path", F.sha2("text", 256))
    n, total, parity = chunks.select(row(1).alias("a"), row(2).alias("b")).agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.expr("bit_xor(b)")).first()
    return hashlib.sha256(f"{n}:{total}:{parity}".encode()).hexdigest()[:32]


CATALOG_SCHEMA = "key string, location string, buckets int, created_at timestamp"


class IndexCatalog:
    """Stored term indexes by the content that they were built from.

    An index is written to a place of its own and becomes visible by one row of the catalog, written last; a key that is not there
    has no index, whatever lies at a path, so changed data never meets an old one. Entries outlive the application.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> DataFrame:
        """Keys with location and buckets; of a key that two jobs have built, the first."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/catalog")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        rows = self.spark.read.schema(CATALOG_SCHEMA).parquet(f"{self.path}/catalog")
        first = F.min_by(F.struct("location", "buckets", "created_at"), F.struct("created_at", "location"))
        return rows.groupBy("key").agg(first.alias("e")).select("key", "e.*")

    def find(self, key: str) -> TermIndex | None:
        found = self.entries().filter(F.col("key") == key).first()
        return None if found is None else read_term_index(self.spark, found.location, found.buckets)

    def build(self, chunks: DataFrame, key: str | None = None) -> TermIndex:
        """The index of these chunks: a stored one where their content has one, else a new one."""
        key = content_key(chunks) if key is None else key
        stored = self.find(key)
        if stored is not None:
            return stored
        location, buckets = f"{self.path}/index-{key}-{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        write_term_index(build_term_index(chunks), location, buckets)
        entry = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(location).alias("location"), F.lit(buckets).cast("int").alias("buckets"), F.current_timestamp().alias("created_at"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")
        return self.find(key)

    def keep_only(self, keys: list[str]) -> None:
        """Forget and delete the indexes of all other keys; no search may be reading them."""
        rows = staged(self.entries(), "catalog-entries")
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = rows.filter(F.col("key").isin(*keys))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalog")
        for row in rows.filter(~F.col("key").isin(*keys)).toLocalIterator():
            self.spark.sql(f"DROP TABLE IF EXISTS {_table_of(row.location)}")
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(row.location), True)


def term_statistics(index: TermIndex) -> DataFrame:
    """(term, field, tf, n, df): uses and chunks of each term by field, and the chunks that have it in the text."""
    names = ("original", "split", "path")
    sums = [a for f in names for a in (F.sum(f).alias(f"tf_{f}"), F.count_if(F.col(f) > 0).alias(f"n_{f}"))]
    terms = index.postings.groupBy("term").agg(*sums, F.count_if(F.col("original") + F.col("split") > 0).alias("df"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"tf_{f}").alias("tf"), F.col(f"n_{f}").alias("n")) for f in names])
    return terms.select("term", F.explode(fields).alias("f"), "df").select("term", "f.*", "df").filter("n > 0")


def terms_of(questions: DataFrame) -> DataFrame:
    """(query_id, term) of questions (query_id, text)."""
    return questions.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))


def _ranked(scored: DataFrame, score: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def asked_postings(asked: DataFrame, index: TermIndex) -> DataFrame:
    """Postings of the terms of (query_id, term) rows alone. The terms are stored first, so Spark knows their size and broadcasts few of them."""
    terms = staged(asked.select("term").distinct(), "asked-terms")
    return staged(index.postings.join(terms, "term", "left_semi"), "asked-postings")


def _best(hits: DataFrame, asked: DataFrame, score: str, k: int) -> DataFrame:
    """The k best chunks of every query by their sums of ``part`` over (chunk_id, part, queries) rows that are dealt by chunk.

    A posting meets all questions with its term as one row, and a task hands on its own k best of every query, so neither hits nor
    (question, chunk) pairs are shuffled.
    """
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    found = hits.select("chunk_id", "part", "queries").sortWithinPartitions("chunk_id").mapInArrow(best_hits(k, 9), f"query_id {kind(asked, 'query_id')}, chunk_id {kind(hits, 'chunk_id')}, score double")
    return _ranked(found.select("query_id", "chunk_id", F.col("score").cast(score).alias("score")), "score", k)


def search_exact(questions: DataFrame, index: TermIndex, k: int) -> DataFrame:
    """Chunks with an exact identifier or path segment of the question: most distinct terms first."""
    asked = staged(terms_of(questions).distinct(), "asked")
    lists = staged(asked.groupBy("term").agg(F.collect_list("query_id").alias("queries")), "asked-lists")
    found = index.postings.filter("original + path > 0").select("term", "chunk_id").join(lists, "term")  # each term once a chunk, so read but once
    return _best(found.repartition("chunk_id").select("chunk_id", F.lit(1.0).alias("part"), "queries"), asked, "long", k)


def search_bm25(questions: DataFrame, index: TermIndex, k: int, k1: float = K1, b: float = B, original: float = ORIGINAL_WEIGHT, split: float = SPLIT_WEIGHT) -> DataFrame:
    """BM25 over two weighted fields."""
    asked = staged(terms_of(questions), "asked")
    found = asked_postings(asked, index).filter("original + split > 0")
    lists = asked.groupBy("term").agg(F.collect_list("query_id").alias("queries"))
    counts = staged(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(lists, "term"), "asked-counts")
    stats = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("original").alias("mean_original"), F.avg("split").alias("mean_split"))
    sizes = index.lengths.select("chunk_id", F.col("original").alias("length_original"), F.col("split").alias("length_split"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def part(field: str, weight: float) -> Column:
        norm = F.col(field) + k1 * (1 - b + b * F.col(f"length_{field}") / F.greatest(f"mean_{field}", F.lit(1e-9)))
        return F.when(F.col(field) > 0, weight * idf * F.col(field) * (k1 + 1) / norm).otherwise(0.0)

    met = found.join(counts, "term").drop("term", "path").repartition("chunk_id").join(sizes.repartition("chunk_id"), "chunk_id").join(F.broadcast(stats))
    return _best(met.withColumn("part", part("original", original) + part("split", split)), asked, "double", k)


def search_semantic(queries: DataFrame, embeddings: DataFrame, k: int) -> DataFrame:
    """Top k by cosine among vectors of the same model version and dimension, exact.

    ``queries`` has query_id, model_version, vector; ``embeddings`` chunk_id, model_version, vector. Both are dealt into blocks by hash and
    meet block by block in one join: the vectors are read once, a cell holds one block of each, and hands on its own top k of
    every query, so the shuffle before the last ranking has k rows a query and block of vectors. With few queries there is one block of
    them, and the vectors are not copied.
    """
    asked = staged(queries.select("query_id", "model_version", F.size("vector").alias("dimension"), "vector"), "queries")
    held = embeddings.select("chunk_id", "model_version", F.size("vector").alias("dimension"), "vector")
    kinds = asked.select("model_version", "dimension").distinct()
    held = held.join(kinds, ["model_version", "dimension"], "left_semi")
    columns, rows = -(-asked.count() // QUERY_BLOCK) or 1, -(-held.count() // VECTOR_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = asked.withColumns({"column": dealt("query_id", columns), "row": every(rows)})
    held = held.withColumns({"row": dealt("chunk_id", rows)}).withColumn("column", every(columns))
    cell = ["model_version", "dimension", "row", "column"]
    ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {embeddings.schema['chunk_id'].dataType.simpleString()}"
    found = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(_best_of_cell(k), f"{ids}, cosine double")
    return _ranked(found, "cosine", k)


def _best_of_cell(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query_id": queries["query_id"][:0], "chunk_id": vectors["chunk_id"][:0], "cosine": np.zeros(0)})
        asked = _unit(np.stack(queries["vector"].to_numpy()).astype(float))
        held, chunk = _unit(np.stack(vectors["vector"].to_numpy()).astype(float)), vectors["chunk_id"].to_numpy()
        out = []
        tile = max(1, TILE_BYTES // (8 * len(chunk)))
        for lo in range(0, len(asked), tile):
            cosine, ids = _nearest(np.round(asked[lo : lo + tile] @ held.T, 6), chunk, k)
            who = np.repeat(queries["query_id"].to_numpy()[lo : lo + tile], cosine.shape[1])
            out.append(pd.DataFrame({"query_id": who, "chunk_id": ids.ravel(), "cosine": cosine.ravel()}))
        return pd.concat(out, ignore_index=True)

    return run


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _nearest(cosine: np.ndarray, chunk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of every row, ties by smallest id. Only what reaches a row's k-th value is sorted."""
    k = min(k, cosine.shape[1])
    least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
    values, ids = np.empty((len(cosine), k)), np.empty((len(cosine), k), dtype=chunk.dtype)
    for i, row in enumerate(cosine):
        near = np.flatnonzero(row >= least[i])
        near = near[np.lexsort((chunk[near], -row[near]))[:k]]
        values[i], ids[i] = row[near], chunk[near]
    return values, ids


def merge_by_rank(*ranked: DataFrame, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank)."""
    lists = ranked[0].select("query_id", "chunk_id", "rank")
    for more in ranked[1:]:
        lists = lists.unionByName(more.select("query_id", "chunk_id", "rank"))
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def drop_overlaps(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drop a chunk whose lines overlap a better kept one of the same file (greedy over a query's short list)."""
    placed = ranked.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "repository_id", "relative_path", "start_line", "end_line"), "chunk_id")

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        kept: dict[tuple, list[tuple[int, int]]] = {}
        keep = []
        for row in frame.sort_values("rank").itertuples():
            spans = kept.setdefault((row.repository_id, row.relative_path), [])
            if not any(a <= row.end_line and row.start_line <= b for a, b in spans):
                spans.append((row.start_line, row.end_line))
                keep.append(row.Index)
        return frame.loc[keep, ["query_id", "chunk_id", "rank"]]

    return placed.groupBy("query_id").applyInPandas(greedy, ranked.select("query_id", "chunk_id", "rank").schema)


def prefer_implementation(ranked: DataFrame, chunks: DataFrame, behaviour: Column, penalty: float = 0.5) -> DataFrame:
    """For behaviour questions documentation scores are multiplied by ``penalty``; ranks are made anew."""
    docs = F.col("language").isin("markdown", "text", "restructuredtext")
    scored = ranked.join(chunks.select("chunk_id", "language"), "chunk_id").withColumn("score", F.when(docs & behaviour, F.col("score") * penalty).otherwise(F.col("score")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).select("query_id", "chunk_id", "score", "rank")


def expand_one_hop(seeds: DataFrame, edges: DataFrame, max_per_seed: int) -> DataFrame:
    """Seeds (query_id, chunk_id) at hop 0 and at most ``max_per_seed`` neighbours of each at hop 1; a seed stays at 0.

    A chunk's first neighbours are the same for all queries, so they are found once, before they meet the seeds. Rows are dealt to
    as many tasks as their number asks for, so that no task sorts more of them when there are more.
    """
    width = max(int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(edges.count() + seeds.count()) // ROWS_PER_TASK))
    asked = seeds.select("query_id", "chunk_id").repartition(width, "chunk_id").distinct()
    linked = edges.select(F.col("from_chunk_id").alias("chunk_id"), "to_chunk_id", "kind").filter("chunk_id is not null").repartition(width, "chunk_id")
    place = F.dense_rank().over(Window.partitionBy("chunk_id").orderBy("kind", "to_chunk_id"))
    first = linked.withColumn("place", place).filter(F.col("place") <= max_per_seed).select("chunk_id", "to_chunk_id").distinct()
    hops = asked.join(first, "chunk_id").select("query_id", F.col("to_chunk_id").alias("chunk_id"), F.lit(1).alias("hop"))
    found = asked.withColumn("hop", F.lit(0)).unionByName(hops).repartition(width, "query_id", "chunk_id")
    return found.groupBy("query_id", "chunk_id").agg(F.min("hop").alias("hop"))


def build_evidence_pack(ranked: DataFrame, chunks: DataFrame, token_budget: int = 10_000, max_items: int = 12) -> DataFrame:
    """Best chunks while the running token sum stays within the budget and the place within the limit."""
    best = Window.partitionBy("query_id").orderBy("rank")
    items = ranked.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "estimated_tokens"), "chunk_id")
    summed = items.withColumn("tokens_used", F.sum("estimated_tokens").over(best.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(best))
    return summed.filter((F.col("tokens_used") <= token_budget) & (F.col("place") <= max_items)).select("query_id", "chunk_id", "rank", "estimated_tokens", "tokens_used")


def packs(items: DataFrame, token_budget: int = 10_000) -> DataFrame:
    """One row per query: its items in order (rank, chunk_id, estimated_tokens), how many tokens they use, and the budget."""
    return items.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "estimated_tokens"))).alias("items"), F.sum("estimated_tokens").alias("tokens_used"), F.lit(token_budget).alias("token_budget")
    )


def assign_source_ids(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Request-local ids S1, S2, ... in rank order, with what a source must tell: path, lines, language, file hash, generation."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    told = chunks.select("chunk_id", "repository_id", "generation_id", "relative_path", "start_line", "end_line", "language", "file_hash")
    return items.withColumn("source_id", F.concat(F.lit("S"), place.cast("string"))).join(told, "chunk_id")


def validate_citations(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, source_id, resolved) of every cited id (answers: query_id, cited array)."""
    cited = answers.select("query_id", F.explode("cited").alias("source_id")).distinct()
    known = items.select("query_id", "source_id", F.lit(True).alias("known")).distinct()
    return cited.join(known, ["query_id", "source_id"], "left").select("query_id", "source_id", F.coalesce("known", F.lit(False)).alias("resolved"))


def insufficient_evidence(questions: DataFrame, items: DataFrame, min_items: int = 1) -> DataFrame:
    counts = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return questions.select("query_id").join(counts, "query_id", "left").select("query_id", F.when(F.coalesce("n", F.lit(0)) >= min_items, "established").otherwise("not established").alias("status"))


def answer_cache_key(repository: Column, generation: Column, query: Column, embedding_version: str, configuration: str) -> Column:
    return F.sha2(F.concat_ws("\0", repository, generation, query, F.lit(embedding_version), F.lit(configuration)), 256)


def evidence_integrity(items: DataFrame, files: DataFrame) -> DataFrame:
    """same, changed or disappeared, by re-slicing each cited range (start_line, end_line, text_hash) from the file now."""
    from ..functions.text import hash_text, slice_lines, split_lines

    now = files.select("repository_id", "relative_path", split_lines(F.col("text")).alias("lines"))
    joined = items.join(now, ["repository_id", "relative_path"], "left")
    current = hash_text(slice_lines(F.col("lines"), F.col("start_line"), F.col("end_line")))
    status = F.when(F.col("lines").isNull(), "disappeared").when(current == F.col("text_hash"), "same").otherwise("changed")
    return joined.select(*items.columns, status.alias("status"))
