"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Training postings (term, doc_id, position) are kept for the terms that tests need; a :class:`PostingIndex` keeps them, and the counts
of terms, from one benchmark to the next, so that a later one scans the corpus only for terms that none before it asked for. Every test window asks
for its two rarest terms by corpus frequency; their posting lists are shifted by the term's offset in the
item, so that lists which belong to one occurrence meet on the same diagonal (document position minus item
position), and grouping by diagonal is the intersection. What survives is checked word by word against the
text, which yields exact phrase hits. The terms of an item's rarest window are also looked up near each other, within a window's
length in any order (proximity). Document lengths are stored as postings of an end-of-text term.

The tables that come from the benchmark are written first, so Spark knows their size when it chooses between
broadcast and shuffle joins. Joins on a term know how often it occurs and salt the frequent ones; the count itself, which
comes before that is known, counts all terms of the corpus; either way what comes from the benchmark is broadcast up to ``VOCABULARY_BYTES``.

Defined results: null text has no words; items without words match nothing; an item shorter than the window
is one window; repeated items each count by their id; repeated documents are counted under their id; an empty
table gives no rows; very long texts are searched whole, as an array of their words in one task; other columns are ignored; a document without an id has a row of its own, with its words counted but no hit looked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, remove, staged

WINDOW = 10
#: Up to this many bytes the terms that a benchmark asks for are broadcast, with what they stand for.
VOCABULARY_BYTES = 8 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END_OF_TEXT = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words that are compared: A-Z lowered, everything else as it is."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def index_terms(text: Column) -> Column:
    """Terms of the index: the same words, fully lowered. Equal words have equal terms, and it is far faster."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ"))), F.lit(WORD), F.lit(0))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, words, terms of items that have words."""
    return items.select("item_id", words(F.col("text")).alias("words"), index_terms(F.col("text")).alias("terms")).filter(F.size("words") > 0)


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences over the whole corpus of each term of the vocabulary, 0 for those that it has not."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    every = docs.select(F.explode(index_terms(F.col("text"))).alias("term"))
    counted = every.join(F.broadcast(vocabulary), "term") if size <= VOCABULARY_BYTES else every
    counts = counted.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return vocabulary.join(counts, "term", "left").select("term", F.coalesce("cf", F.lit(0)).alias("cf"))


def located(rows: DataFrame, terms: DataFrame, total: int, width: Column, key: str | list[str] = "term") -> DataFrame:
    """``rows`` (doc_id, pos, term) that are of ``terms`` (term, cf), with their columns; ``width`` is about the bytes of one of these.

    A table of proven small size is broadcast, so that no word of the corpus is shuffled; a larger one is joined with its frequent
    terms salted (``total`` occurrences in all).
    """
    if (terms.agg(F.sum(width)).first()[0] or 0) <= VOCABULARY_BYTES:
        return rows.join(F.broadcast(terms), key)
    return hot_join(rows, terms, key, "cf", total, F.struct("doc_id", "pos"))


def build_postings(docs: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """term, doc_id, pos (0-based) of the given terms (term, cf; ``total`` occurrences in all); the end-of-text term holds each document's length."""
    with_end = F.concat(index_terms(F.col("text")), F.array(F.lit(END_OF_TEXT)))
    every = docs.select("doc_id", F.posexplode(with_end).alias("pos", "term"))
    return located(every, terms, total, F.octet_length("term") + 24).select("term", "doc_id", "pos")


def rarest_terms(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, start, first and second (struct of offset, term): the two rarest terms of every window that can occur."""
    by_place = (
        items.select("item_id", F.posexplode("terms").alias("off", "term"))
        .join(counts, "term")
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce("cf", F.lit(0)).alias("cf"), "term"))).alias("places"))
    )
    size = F.least(F.size("places"), F.lit(window))
    two = F.transform(
        F.sequence(F.lit(0), F.size("places") - size),
        lambda s: F.slice(
            F.array_sort(F.transform(F.slice("places", s + 1, size), lambda x: F.struct(x["cf"].alias("cf"), x["off"].alias("off"), x["term"].alias("term")))), 1, 2
        ),
    )
    return (
        by_place.select("item_id", F.posexplode(two).alias("start", "two"))
        .select("item_id", "start", F.col("two")[0].alias("first"), F.element_at("two", -1).alias("second"))
        .filter("first.cf > 0")
    )


def phrase_matches(docs: DataFrame, items: DataFrame, postings: DataFrame, rare: DataFrame, total: int, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, positions: the document words (0-based) inside occurrences of the item's windows."""
    wanted = rare.select("item_id", F.explode(F.array("first", "second")).alias("t")).select("item_id", "t.*")
    wanted = wanted.groupBy("term").agg(F.max("cf").alias("cf"), F.collect_set(F.struct("item_id", "off")).alias("places"))
    needs = staged(
        rare.groupBy("item_id").agg(F.collect_set(F.struct(F.col("first.off").alias("x"), F.col("second.off").alias("y"))).alias("needs")), "needs"
    )
    diagonals = (
        located(postings.filter(F.col("term") != END_OF_TEXT), staged(wanted, "wanted"), total, F.octet_length("term") + 32 + 24 * F.size("places"))
        .select("doc_id", "pos", F.explode("places").alias("p"))
        .select("doc_id", "pos", "p.*")
        .groupBy("doc_id", "item_id", (F.col("pos") - F.col("off")).alias("diag"))
        .agg(F.collect_set("off").alias("offs"))
        .join(needs, "item_id")
        .filter(F.exists("needs", lambda n: F.array_contains("offs", n["x"]) & F.array_contains("offs", n["y"])))
        .select("doc_id", "item_id", "diag")
    )
    lengths = items.select("item_id", F.size("words").alias("n"))
    found = staged(diagonals.join(lengths, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diag", "n")).alias("found")), "diagonals")
    texts = docs.select("doc_id", "text").join(found, "doc_id").select("doc_id", words(F.col("text")).alias("dw"), "found")
    parts = texts.select(
        "doc_id",
        F.explode(
            F.transform(
                "found",
                lambda c: F.struct(
                    c["item_id"].alias("item_id"),
                    c["diag"].alias("diag"),
                    F.greatest(c["diag"], F.lit(0)).alias("lo"),
                    F.slice("dw", F.greatest(c["diag"], F.lit(0)) + 1, c["n"] + F.least(c["diag"], F.lit(0))).alias("part"),
                ),
            )
        ).alias("c"),
    ).select("doc_id", "c.*")
    same = F.zip_with("part", F.slice("words", F.col("lo") - F.col("diag") + 1, F.greatest(F.size("part"), F.lit(1))), lambda a, b: a.eqNullSafe(b))
    size = F.least(F.size("words"), F.lit(window))
    starts = F.when(
        F.size("part") >= size, F.filter(F.sequence(F.lit(0), F.size("part") - size), lambda s: F.forall(F.slice("same", s + 1, size), lambda m: m))
    ).otherwise(F.array().cast("array<int>"))
    return (
        parts.join(items.select("item_id", "words"), "item_id")
        .withColumn("same", same)
        .withColumn("starts", starts)
        .filter(F.size("starts") > 0)
        .select("doc_id", "item_id", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(F.col("lo") + s, F.col("lo") + s + size - 1)))).alias("positions"))
    )


def proximity_matches(postings: DataFrame, pairs: DataFrame, slop: int, total: int) -> DataFrame:
    """doc_id and pair_id of documents where both terms of a pair (pair_id, left_term, left_cf, right_term, right_cf) lie within ``slop`` words.

    Positions are grouped into blocks of ``slop`` words, so the join is on (document, block) and not on all positions.
    """
    block = F.floor(F.col("pos") / slop)

    def side(name: str) -> DataFrame:
        asked = pairs.groupBy(F.col(f"{name}_term").alias("term")).agg(F.max(f"{name}_cf").alias("cf"), F.collect_set("pair_id").alias("pairs"))
        return located(postings, staged(asked, "pairs"), total, F.octet_length("term") + 32 + 16 * F.size("pairs")).select("doc_id", "pos", F.explode("pairs").alias("pair_id"))

    left = side("left").select("pair_id", "doc_id", F.col("pos").alias("p"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = side("right").select("pair_id", "doc_id", F.col("pos").alias("q"), block.alias("block"))
    return left.join(right, ["pair_id", "doc_id", "block"]).filter((F.abs(F.col("p") - F.col("q")) <= slop) & (F.col("p") != F.col("q"))).select("pair_id", "doc_id").distinct()


def rarest_pairs(rare: DataFrame) -> DataFrame:
    """pair_id (the item), left_term, left_cf, right_term, right_cf: the two terms of the item's window with the rarest first one."""
    best = rare.groupBy("item_id").agg(F.min_by(F.struct("first", "second"), F.struct("first.cf", "start")).alias("w"))
    return best.select(
        F.col("item_id").alias("pair_id"), F.col("w.first.term").alias("left_term"), F.col("w.first.cf").alias("left_cf"),
        F.col("w.second.term").alias("right_term"), F.col("w.second.cf").alias("right_cf"),
    )


class PostingIndex:
    """Counts and postings of one corpus that stay for later benchmarks, under a path of its own.

    The path belongs to the content of the corpus (:meth:`of`), so documents that have changed meet no old postings. Each batch of terms is
    written to a place of its own and counts once its terms are listed, so an unfinished one is never read.
    """

    def __init__(self, docs: DataFrame, path: str):
        self.docs, self.spark, self.path = docs, docs.sparkSession, path.rstrip("/")

    @classmethod
    def of(cls, docs: DataFrame, base: str) -> PostingIndex:
        """The index of these documents below ``base``: its name is the count, sum and exclusive or of 64-bit hashes of all rows."""
        row = lambda seed: F.xxhash64(F.lit(seed), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256))
        n, total, parity = docs.select(row(1).alias("a"), row(2).alias("b")).agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.expr("bit_xor(b)")).first()
        return cls(docs, f"{base.rstrip('/')}/corpus-{n}-{total or 0}-{parity or 0}")

    def _read(self, name: str, schema: str) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def counts(self, vocabulary: DataFrame) -> DataFrame:
        known = self._read("counts", "term string, cf long")
        new = staged(vocabulary.join(known, "term", "left_anti"), "new-terms")
        if not new.isEmpty():
            term_counts(self.docs, new).write.mode("append").parquet(f"{self.path}/counts")
        stored = self._read("counts", "term string, cf long").groupBy("term").agg(F.max("cf").alias("cf"))
        return stored.join(vocabulary, "term", "left_semi")

    def postings(self, terms: DataFrame, total: int) -> DataFrame:
        listed = "term string, batch string"
        new = staged(terms.join(self._read("indexed", listed), "term", "left_anti"), "new-terms")
        if not new.isEmpty():
            batch = uuid.uuid4().hex
            build_postings(self.docs, new, total).write.parquet(f"{self.path}/postings/batch={batch}")
            new.select("term", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/indexed")
        batches = self._read("indexed", listed).groupBy("term").agg(F.min("batch").alias("batch"))
        rows = self.spark.read.schema("term string, doc_id long, pos int, batch string").parquet(f"{self.path}/postings")
        wanted = staged(batches.join(terms, "term"), "wanted-batches")
        return located(rows, wanted, total, F.octet_length("term") + 64, ["term", "batch"]).select("term", "doc_id", "pos")

    def drop(self) -> None:
        remove(self.spark, self.path)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index: PostingIndex | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated, n_near.

    ``n_near`` counts the items of whose rarest window both terms lie within ``window`` words of each other. An ``index`` of the same
    documents is read, and extended by what it lacks.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    items = staged(item_terms(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")), "items")
    vocabulary = staged(items.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = staged(term_counts(texts, vocabulary) if index is None else index.counts(vocabulary), "term-counts")
    total = counts.agg(F.sum("cf")).first()[0] or 0
    rare = staged(rarest_terms(items, counts, window), "rare-terms")
    used = rare.select(F.explode(F.array("first", "second")).alias("t")).groupBy("t.term").agg(F.max("t.cf").alias("cf"))
    used = staged(used.union(docs.sparkSession.range(1).select(F.lit(END_OF_TEXT).alias("term"), F.lit(texts.count()).alias("cf"))), "used-terms")
    postings = staged(build_postings(texts, used, total) if index is None else index.postings(used, total), "postings")
    hits = phrase_matches(texts, items, postings, rare, total, window)
    per_doc = hits.groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    near = proximity_matches(postings.filter(F.col("term") != END_OF_TEXT), staged(rarest_pairs(rare), "rarest-pairs"), window, total)
    near = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_near"))
    lengths = postings.filter(F.col("term") == END_OF_TEXT).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return lengths.join(per_doc, "doc_id", "left").join(near, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
