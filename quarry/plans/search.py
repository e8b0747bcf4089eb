"""Queries over retrieval and evaluation: benchmark passages ask document chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import evaluation, incremental, manifest, retrieval
from ..session import scratch, shared, staged, stored
from .files import FILES, SPLIT, _STOPS, _WORDS_SQL, tokens_sql
from .index import GENERATIONS, VERSIONS, hashed
from .registry import query, table
from .talk import ENVELOPES, envelopes


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per document: chunk_id, repository_id, relative_path, start_line, end_line, language, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("repository_id"), F.concat(F.lit("docs/"), "lang").alias("relative_path"),
        (F.col("doc_id") * 10 + 1).cast("int").alias("start_line"), (F.col("doc_id") * 10 + 1 + F.col("doc_id") % 25).cast("int").alias("end_line"),
        F.when(F.col("doc_id") % 4 == 0, "markdown").otherwise("python").alias("language"), TX.estimate_tokens(F.col("text")).alias("estimated_tokens"), "text",
    )


PASSAGES = f"(SELECT doc_id AS chunk_id, source AS repository_id, 'docs/' || lang AS relative_path, (doc_id * 10 + 1)::INT AS start_line, (doc_id * 10 + 1 + doc_id % 25)::INT AS end_line, CASE WHEN doc_id % 4 = 0 THEN 'markdown' ELSE 'python' END AS language, {tokens_sql('text')} AS estimated_tokens, text FROM documents)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TERMS = f"""
q_t AS (SELECT query_id, unnest(tokens) AS w FROM (SELECT item_id AS query_id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS tokens FROM benchmark)),
q_k AS (SELECT query_id, w FROM q_t WHERE lower(w) NOT IN ({_STOPS}) AND length(w) >= 2),
terms AS (SELECT DISTINCT query_id, w AS term FROM (SELECT query_id, lower(w) AS w FROM q_k UNION ALL SELECT query_id, lower(unnest({_WORDS_SQL.format('w')})) FROM q_k) WHERE length(w) >= 2 AND w NOT IN ({_STOPS}))"""
INDEX = f"""
c_o AS (SELECT chunk_id, 'original' AS field, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_$]+'), lambda s: lower(s))) AS term FROM {PASSAGES}),
c_i AS (SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM {PASSAGES}),
c_p AS (SELECT chunk_id, 'path' AS field, lower(unnest(string_split(relative_path, '/'))) AS term FROM {PASSAGES}),
c_s AS (SELECT DISTINCT chunk_id, 'split' AS field, lower(unnest(parts)) AS term FROM (SELECT chunk_id, {_WORDS_SQL.format('w')} AS parts FROM c_i) WHERE len(parts) > 1),
postings AS (SELECT term, chunk_id, field, count(*) AS tf FROM (SELECT * FROM c_o UNION ALL SELECT chunk_id, field, term FROM c_p UNION ALL SELECT chunk_id, field, term FROM c_s) GROUP BY ALL),
lengths AS (SELECT chunk_id, f.field, coalesce(n, 0) AS length FROM (SELECT chunk_id FROM {PASSAGES}) CROSS JOIN (VALUES ('original'), ('split')) AS f(field) LEFT JOIN (SELECT chunk_id, field, sum(tf) AS n FROM postings GROUP BY ALL) USING (chunk_id, field)),
dfs AS (SELECT term, count(DISTINCT chunk_id) AS df FROM postings WHERE field <> 'path' GROUP BY term)"""
BM25 = f"""{TERMS}, {INDEX},
stats AS (SELECT field, avg(length) AS mean_length, count(*) AS n FROM lengths GROUP BY field),
bm AS (
  SELECT query_id, chunk_id, round(sum(CASE WHEN field = 'original' THEN 2.0 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(mean_length, 1e-9)))), 9) AS score
  FROM postings JOIN terms USING (term) JOIN dfs USING (term) JOIN lengths USING (chunk_id, field) JOIN stats USING (field) GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bm) WHERE rank <= 20)"""
EXACT = """
ex AS (SELECT query_id, chunk_id, count(DISTINCT term) AS score FROM postings JOIN terms USING (term) WHERE field IN ('original', 'path') GROUP BY ALL),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM ex) WHERE rank <= 20)"""
FUSED = f"""{BM25}, {EXACT},
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.e, c.e) / greatest(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e)), 1e-12), 6) AS cosine FROM v q JOIN benchmark ON item_id = q.vec_id, v c WHERE c.vec_id IN (SELECT doc_id FROM documents)),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INT AS rank FROM near) WHERE rank <= 20),
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM bm25 UNION ALL SELECT query_id, chunk_id, rank FROM exact UNION ALL SELECT query_id, chunk_id, rank FROM nearest) GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM fu)"""

def stored_index(spark: SparkSession, sf_dir: str) -> retrieval.TermIndex:
    """The term index of the passages, found by their content or written now; every search of the same passages reads the same one."""
    return retrieval.IndexCatalog(spark, shared(spark, "term-indexes")).build(passages(spark, sf_dir))


#: The passages by file, some gone, some new and some edited since: an edited text is a chunk of its own.
_EDITED = "(SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000000 ELSE 0 END AS chunk_id, 'docs/' || lang || '/' || doc_id AS relative_path, CASE WHEN doc_id % 7 = 0 THEN text || ' editedOnce' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


def _editions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of two generations, and the plan that leads from one to the other."""
    n = F.col("chunk_id")
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repository_id"), path.alias("relative_path"), "text")
    edited = n % 7 == 0
    old = rows.filter(n % 13 != 0)
    new = rows.filter(n % 11 != 0).withColumns({"chunk_id": F.when(edited, n + 1_000_000_000).otherwise(n), "text": F.when(edited, F.concat("text", F.lit(" editedOnce"))).otherwise(F.col("text"))})
    listed = [t.select("repository_id", "relative_path", TX.hash_text(F.col("text")).alias("content_hash")) for t in (old, new)]
    return old, new, manifest.plan_refresh(manifest.diff_manifests(*listed), old.select("repository_id", "relative_path", "chunk_id"))


@query(f"WITH {INDEX.replace(PASSAGES, _EDITED)} SELECT term, field, sum(tf)::BIGINT AS tf, count(*) AS n, coalesce(df, 0) AS df FROM postings LEFT JOIN dfs USING (term) GROUP BY ALL")
def m7_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first generation indexed, then refreshed by the plan: the index of both segments is that of the second generation."""
    old, new, plan = _editions(spark, sf_dir)
    index = incremental.SegmentedIndex(spark, scratch(spark, "segments"))
    index.refresh(old, old.select("chunk_id").limit(0))
    incremental.refresh_index(index, plan, new)
    return retrieval.term_statistics(index.read())


@query(f"""WITH n AS {_EDITED}, gone AS (SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 13 <> 0 AND (doc_id % 11 = 0 OR doc_id % 7 = 0)),
stored AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 <> 0 THEN 'm1' ELSE 'm0' END AS model_version FROM embeddings),
kept AS (SELECT * FROM stored WHERE model_version = 'm1' AND chunk_id IN (SELECT chunk_id FROM n) AND chunk_id NOT IN (SELECT chunk_id FROM gone))
SELECT *, 'reuse' AS action FROM kept UNION ALL SELECT *, 'delete' FROM (SELECT * FROM stored EXCEPT SELECT * FROM kept)
UNION ALL SELECT chunk_id, 'm1', 'embed' FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM kept)""")
def m7_plan_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new, plan = _editions(spark, sf_dir)
    version = F.when(F.col("vec_id") % 3 != 0, "m1").otherwise("m0")
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), version.alias("model_version"))
    return incremental.plan_embeddings(plan, new, stored, "m1")


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_bm25(questions(spark, sf_dir), stored_index(spark, sf_dir), 20)


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_exact(questions(spark, sf_dir), stored_index(spark, sf_dir), 20)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit("m1").alias("model_version"), F.col("embedding").alias("vector"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question asks with the vector of its own number, among those of the corpus's chunks."""
    vectors = _vectors(spark, sf_dir)
    held = passages(spark, sf_dir).select("chunk_id")
    asked = vectors.withColumnRenamed("vec_id", "query_id").join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    return retrieval.search_semantic(asked, vectors.withColumnRenamed("vec_id", "chunk_id").join(held, "chunk_id", "left_semi"), 20)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lists fused, stored once for the content of passages, questions and vectors: packs, citations and checks read the same table."""
    asked = questions(spark, sf_dir).select(F.col("query_id").alias("chunk_id"), F.lit("").alias("relative_path"), "text")
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), F.col("model_version").alias("relative_path"), F.to_json(F.struct("vector")).alias("text"))
    parameters = (retrieval.K1, retrieval.B, retrieval.ORIGINAL_WEIGHT, retrieval.SPLIT_WEIGHT, retrieval.FUSION, 20)
    key = "-".join([*map(str, parameters), *(retrieval.content_key(t) for t in (passages(spark, sf_dir), asked, vectors))])
    return stored(spark, f"fused-{key}", lambda: retrieval.merge_by_rank(_bm25(spark, sf_dir), _exact(spark, sf_dir), _nearest(spark, sf_dir)))


@query(f"WITH g AS ({GENERATIONS}) SELECT relative_path FROM {FILES} f JOIN g ON g.repository_id = f.repository_id WHERE f.repository_id = 'src1'")
def q1_scope_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    ids = manifest.generation_ids(rows, VERSIONS)
    stamped = rows.join(ids.select("repository_id", "generation_id"), "repository_id")
    one = ids.filter("repository_id = 'src1'").select("generation_id").first()
    return retrieval.scope_chunks(stamped, ids, "src1", one.generation_id if one else "").select("relative_path")


@query(f"WITH {INDEX} SELECT term, field, sum(tf)::BIGINT AS tf, count(*) AS n, coalesce(df, 0) AS df FROM postings LEFT JOIN dfs USING (term) GROUP BY ALL")
def q2_build_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_statistics(stored_index(spark, sf_dir))


@query(f"WITH {TERMS}, {INDEX}, {EXACT} SELECT query_id, chunk_id, score, rank FROM exact")
def q3_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir)


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def q4_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


SEMANTIC = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
cs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.e, c.e) / greatest(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e)), 1e-12), 6) AS cosine FROM v q, v c WHERE q.vec_id % 20 = 0),
semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INT AS rank FROM cs) WHERE rank <= 10)"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.search_semantic(asked, vectors.withColumnRenamed("vec_id", "chunk_id"), 10)


@query(f"WITH {SEMANTIC} SELECT query_id, chunk_id, cosine, rank FROM semantic")
def q5_search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir)


@query(f"WITH {FUSED} SELECT query_id, chunk_id, score, rank FROM fused")
def q6_merge_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query(f"""WITH RECURSIVE {FUSED},
sp AS (SELECT query_id, chunk_id, rank, repository_id || '/' || relative_path AS f, start_line AS a, end_line AS b FROM fused JOIN {PASSAGES} USING (chunk_id)),
greedy AS (
  SELECT query_id, rank, chunk_id, true AS keep, [{{'f': f, 'a': a, 'b': b}}] AS kept FROM sp WHERE rank = 1
  UNION ALL
  SELECT query_id, rank, chunk_id, k, CASE WHEN k THEN list_append(kept, {{'f': f, 'a': a, 'b': b}}) ELSE kept END
  FROM (SELECT sp.query_id, sp.rank, sp.chunk_id, f, a, b, kept, len(list_filter(kept, lambda x: x.f = sp.f AND x.a <= sp.b AND sp.a <= x.b)) = 0 AS k FROM greedy g JOIN sp ON sp.query_id = g.query_id AND sp.rank = g.rank + 1))
SELECT query_id, chunk_id, rank FROM greedy WHERE keep""")
def q7_drop_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.drop_overlaps(_fused(spark, sf_dir), passages(spark, sf_dir))


PREFERRED = f"""{FUSED},
pr AS (SELECT query_id, chunk_id, CASE WHEN language = 'markdown' AND query_id % 2 = 0 THEN score * 0.5 ELSE score END AS score FROM fused JOIN {PASSAGES} USING (chunk_id)),
preferred AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pr)"""


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prefer_implementation(_fused(spark, sf_dir), passages(spark, sf_dir), F.col("query_id") % 2 == 0)


@query(f"WITH {PREFERRED} SELECT * FROM preferred")
def q8_prefer_implementation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preferred(spark, sf_dir)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("from_chunk_id"), F.col("l_partkey").alias("to_chunk_id"), F.col("l_returnflag").alias("kind"))


@query("""WITH s AS (SELECT DISTINCT c_nationkey::BIGINT AS query_id, o_orderkey AS chunk_id FROM customer JOIN orders ON o_custkey = c_custkey),
n AS (SELECT query_id, l_partkey AS chunk_id, row_number() OVER (PARTITION BY query_id, s.chunk_id ORDER BY kind, l_partkey) AS k FROM s JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag AS kind FROM lineitem) ON l_orderkey = chunk_id)
SELECT query_id, chunk_id, min(hop)::INT AS hop FROM (SELECT query_id, chunk_id, 0 AS hop FROM s UNION ALL SELECT query_id, chunk_id, 1 FROM n WHERE k <= 3) GROUP BY ALL""")
def q9_expand_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return retrieval.expand_one_hop(seeds.select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("o_orderkey").alias("chunk_id")), _edges(spark, sf_dir), 3)


PACK = f"""{FUSED},
pk AS (SELECT query_id, chunk_id, rank, estimated_tokens, sum(estimated_tokens) OVER w::BIGINT AS tokens_used, row_number() OVER w AS place FROM fused JOIN {PASSAGES} USING (chunk_id) WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
pack AS (SELECT query_id, chunk_id, rank, estimated_tokens, tokens_used, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_id FROM pk WHERE tokens_used <= 10000 AND place <= 12)""".replace("OVER w::BIGINT", "OVER w")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build_evidence_pack(_fused(spark, sf_dir), passages(spark, sf_dir))


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = manifest.generation_ids(hashed(spark, sf_dir), VERSIONS).select("repository_id", "generation_id")
    chunks = passages(spark, sf_dir).withColumn("file_hash", TX.hash_text(F.col("text"))).join(ids, "repository_id")
    return staged(retrieval.assign_source_ids(_items(spark, sf_dir), chunks), "pack")


@query(f"WITH {PACK} SELECT query_id, chunk_id, rank, estimated_tokens, tokens_used::BIGINT AS tokens_used FROM pack")
def q10_build_evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


@query(f"WITH {PACK} SELECT query_id, count(*)::INT AS n_items, string_agg(chunk_id || ':' || estimated_tokens, ',' ORDER BY rank) AS items, sum(estimated_tokens)::BIGINT AS tokens_used, 10000 AS token_budget FROM pack GROUP BY query_id")
def q10_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["chunk_id"].cast("string"), x["estimated_tokens"].cast("string"))), ",")
    return retrieval.packs(_items(spark, sf_dir)).select("query_id", F.size("items").alias("n_items"), shown.alias("items"), "tokens_used", "token_budget")


@query(f"WITH {PACK}, g AS ({GENERATIONS}) SELECT query_id, chunk_id, source_id, p.repository_id, generation_id, relative_path, start_line, end_line, language, sha256(p.text) AS file_hash FROM pack JOIN {PASSAGES} p USING (chunk_id) JOIN g ON g.repository_id = p.repository_id")
def q11_assign_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).select("query_id", "chunk_id", "source_id", "repository_id", "generation_id", "relative_path", "start_line", "end_line", "language", "file_hash")


@query(f"WITH {PACK} SELECT DISTINCT i.query_id, 'S' || k AS source_id, (i.query_id, 'S' || k) IN (SELECT (query_id, source_id) FROM pack) AS resolved FROM (SELECT item_id AS query_id, unnest([1, item_id % 9 + 2, item_id % 30 + 1]) AS k FROM benchmark) i")
def q12_validate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("query_id")
    cited = F.transform(F.array(F.lit(1).cast("long"), n % 9 + 2, n % 30 + 1), lambda k: F.concat(F.lit("S"), k.cast("string")))
    return retrieval.validate_citations(questions(spark, sf_dir).select("query_id", cited.alias("cited")), _pack(spark, sf_dir))


@query(f"WITH {PACK} SELECT item_id AS query_id, CASE WHEN (SELECT count(*) FROM pack WHERE query_id = item_id) >= 8 THEN 'established' ELSE 'not established' END AS status FROM benchmark")
def q13_insufficient_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.insufficient_evidence(questions(spark, sf_dir), _pack(spark, sf_dir), 8)


@query("SELECT item_id, sha256('src' || item_id % 20 || chr(0) || 'g' || item_id % 3 || chr(0) || text || chr(0) || 'e1' || chr(0) || 'short') AS cache_key FROM benchmark")
def q14_answer_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    key = retrieval.answer_cache_key(F.concat(F.lit("src"), (n % 20).cast("string")), F.concat(F.lit("g"), (n % 3).cast("string")), F.col("text"), "e1", "short")
    return table(spark, sf_dir, "benchmark").select("item_id", key.alias("cache_key"))


def _two_lines(text: str) -> str:
    return f"array_to_string({SPLIT.replace('text', text)}[1:2], chr(10))"


_NOW = "(CASE doc_id % 5 WHEN 3 THEN 'x' || text WHEN 2 THEN text || ' more' WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END)"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'disappeared' WHEN sha256({_two_lines('text')}) = sha256({_two_lines('now')}) THEN 'same' ELSE 'changed' END AS status FROM (SELECT doc_id, text, {_NOW} AS now FROM documents)")
def q15_evidence_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of each file are cited; some files are gone since, some changed before, inside or behind them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("r").alias("repository_id"), F.col("doc_id").cast("string").alias("relative_path"), "text")
    lines = TX.split_lines(F.col("text"))
    items = docs.select("doc_id", "repository_id", "relative_path", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), TX.hash_text(TX.slice_lines(lines, F.lit(1), F.lit(2))).alias("text_hash"))
    n = F.col("doc_id") % 5
    edited = F.when(n == 3, F.concat(F.lit("x"), "text")).when(n == 2, F.concat("text", F.lit(" more"))).when(n == 1, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return retrieval.evidence_integrity(items, docs.filter("doc_id % 5 <> 4").withColumn("text", edited)).select("doc_id", "status")


# ---- evaluation

EVIDENCE = f"(SELECT i.item_id AS question_id, repository_id, relative_path, start_line, end_line FROM benchmark i JOIN {PASSAGES} p ON contains(p.text, i.text))"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each passage is quoted.

    A quote may begin and end inside a word of the text, so it is found through its inner words: a run of four from the second on, or
    the second one where there are fewer. Only what has no inner word is compared with every text.
    """
    words = lambda c: F.split(c, "[ \n]", -1)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("quote"), words("text").alias("w"))
    width = F.when(F.size("w") >= 6, 4).when(F.size("w") >= 3, 1).otherwise(0)
    asked = staged(asked.select("question_id", "quote", width.alias("width"), F.array_join(F.slice("w", 2, width), " ").alias("gram")), "quotes")
    chunks = passages(spark, sf_dir)
    fours = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 4), " "))
    runs = {4: F.transform(F.array(words("text")), fours)[0], 1: words("text")}  # the outer lambda binds the words once
    met = asked.filter("width = 0").select("question_id").crossJoin(chunks.select("chunk_id"))
    for n, run in runs.items():
        grams = chunks.select("chunk_id", F.explode(F.array_distinct(run)).alias("gram"))
        met = met.union(grams.join(asked.filter(F.col("width") == n), "gram").select("question_id", "chunk_id"))
    found = met.join(asked.select("question_id", "quote"), "question_id").join(chunks, "chunk_id").filter(F.contains("text", "quote"))
    return found.select("question_id", "repository_id", "relative_path", "start_line", "end_line").distinct()


@query(f"""WITH {FUSED}, ev AS {EVIDENCE},
h AS (SELECT DISTINCT e.question_id FROM ev e JOIN fused f ON f.query_id = e.question_id AND f.rank <= 10 JOIN {PASSAGES} p ON p.chunk_id = f.chunk_id AND p.repository_id = e.repository_id AND p.relative_path = e.relative_path AND p.start_line <= e.end_line AND e.start_line <= p.end_line)
SELECT DISTINCT question_id, question_id IN (SELECT question_id FROM h) AS hit FROM ev""")
def e1_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _fused(spark, sf_dir).join(passages(spark, sf_dir), "chunk_id").withColumnRenamed("query_id", "question_id")
    return evaluation.recall_at_k(_evidence(spark, sf_dir), ranked, 10)


@query("SELECT round(avg(toxic) FILTER (quality = 1), 9) AS support_rate, round(avg(doc_id % 3) FILTER (quality = 0) / 1.0, 9) AS unanswerable_rate, count(*) AS n FROM (SELECT doc_id % 2 AS b, quality, toxic, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS doc_id FROM labels)")
def e2_answer_support_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("supported"), (F.col("doc_id") % 3 != 0).alias("flagged"))
    rates = evaluation.answer_support_rates(judged)
    return rates.select(F.round("support_rate", 9).alias("support_rate"), F.round("unanswerable_rate", 9).alias("unanswerable_rate"), "n")


@query("""WITH p AS (SELECT doc_id FROM documents WHERE contains(text, '%%%') OR contains(text, '###')), t AS (SELECT doc_id FROM labels WHERE quality = 0),
c AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN t USING (doc_id))
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall FROM c""")
def e3_detection_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("%%%")) | F.contains("text", F.lit("###")))
    out = evaluation.detection_precision_recall(predicted, table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")
    return out.select("tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


PAIRS = f"""{ENVELOPES},
pairs AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{a}', '{b}')" for m, a, b in evaluation.LATENCIES)}) AS p(metric, starts, ends)),
timed AS (
  SELECT metric, s.request_id, s.timestamp_ms AS started_ms,
         (SELECT min(e.timestamp_ms) FROM env e WHERE e.request_id = s.request_id AND e.type = ends AND (e.timestamp_ms, e.event_id) >= (s.timestamp_ms, s.event_id)) - s.timestamp_ms AS latency_ms
  FROM env s JOIN pairs ON s.type = starts)"""


@query(f"WITH {PAIRS} SELECT metric, request_id, started_ms, latency_ms FROM timed")
def e4_next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.next_events(envelopes(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT metric, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM timed WHERE latency_ms IS NOT NULL GROUP BY metric")
def e4_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a question's end to its sources, first text and completion, out of raw envelopes."""
    out = evaluation.latency_percentiles(evaluation.next_events(envelopes(spark, sf_dir)).filter("latency_ms is not null"))
    return out.select("metric", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query("""WITH m AS (SELECT p_brand AS metric, avg(p_retailprice::DOUBLE) AS value, count(*) AS n FROM part GROUP BY p_brand), g AS (SELECT DISTINCT p_brand AS metric, 1400.0::DOUBLE AS target, p_brand < 'Brand#3' AS at_least FROM part)
SELECT metric, round(value, 6) AS value, target, CASE WHEN at_least THEN value >= target ELSE value <= target END AS passed, n FROM m JOIN g USING (metric)""")
def e5_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    metrics = part.groupBy(F.col("p_brand").alias("metric")).agg(F.avg(F.col("p_retailprice").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    gates = part.select(F.col("p_brand").alias("metric"), F.lit(1400.0).alias("target"), (F.col("p_brand") < "Brand#3").alias("at_least")).distinct()
    return evaluation.gate_report(metrics, gates).withColumn("value", F.round("value", 6))


_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'held_out' ELSE 'development' END AS split, {_NORM} AS norm FROM documents) SELECT h.doc_id AS held_out_id, min(o.doc_id) AS other_id, o.split AS other_split, count(*) AS n_others FROM q h JOIN q o ON o.norm = h.norm AND o.split <> 'held_out' WHERE h.split = 'held_out' GROUP BY h.doc_id, o.split")
def e6_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "held_out").otherwise("development").alias("split"), "text")
    return evaluation.split_leakage(docs)


@query("SELECT split, n, split <> 'held_out' OR n >= 100 AS enough FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'held_out' ELSE 'development' END AS split, count(*) AS n FROM documents GROUP BY 1)")
def e6_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.split_counts(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "held_out").otherwise("development").alias("split")))
