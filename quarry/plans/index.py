"""Queries over manifests, refresh plans, reports, secrets and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options as O
from ..functions import text as TX
from ..operators import chunking, manifest, reports, secrets, walk
from ..session import scratch, staged
from ..sources import generations, repo_tree
from .files import CHUNKING, CHUNKS, DISCOVER, FILES, LIMITS, LISTING, REDACTED, RULE_SQL, SAFE, _MINIFIED, discovery, file_chunk_sql, files, listing, safe_files
from .registry import query, table

VERSIONS = O.Versions("c1", "p1", "e1")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the hash of their redacted text."""
    rows = safe_files(spark, sf_dir)
    return rows.select("doc_id", "repository_id", "relative_path", TX.hash_text(F.col("text")).alias("content_hash"), "size_bytes", F.lit("text").alias("language"))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the redacted texts of files that have a path, with their ids, in one pass over the files."""
    rows = safe_files(spark, sf_dir).filter(F.col("relative_path").isNotNull()).select("repository_id", "relative_path", F.lit("text").alias("language"), "text", TX.hash_text(F.col("text")).alias("content_hash"))
    return chunking.with_ids(chunking.chunk_files(rows, CHUNKING))


HASHED = f"(SELECT doc_id, repository_id, relative_path, sha256(text) AS content_hash, size_bytes FROM {SAFE})"
IDS = CHUNKS + f""", ids AS (
  SELECT h.repository_id, relative_path, content_hash, start_line, end_line, estimated_tokens, c.text,
         left(sha256(relative_path || chr(0) || content_hash || chr(0) || start_line || chr(0) || end_line), 32) AS chunk_id
  FROM chunks c JOIN {HASHED} h USING (relative_path))"""


@query("SELECT doc_id, sha256(encode(text)) AS digest FROM documents")
def m1_hash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", TX.hash_bytes(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def m2_hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", TX.hash_text(F.col("html")).alias("digest"))


@query(IDS + " SELECT relative_path, start_line, chunk_id FROM ids")
def m3_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).select("relative_path", "start_line", "chunk_id")


@query(IDS + f" SELECT h.repository_id, h.relative_path, h.content_hash, h.size_bytes, coalesce((SELECT string_agg(chunk_id, ',' ORDER BY start_line) FROM ids i WHERE i.relative_path = h.relative_path), '') AS chunk_ids FROM {HASHED} h")
def m4_build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = manifest.build_manifest(hashed(spark, sf_dir), identified(spark, sf_dir))
    return built.select("repository_id", "relative_path", "content_hash", "size_bytes", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def generation_sql(source: str) -> str:
    return f"SELECT repository_id, left(sha256(repository_id || chr(0) || 'c1' || chr(0) || 'p1' || chr(0) || 'e1' || string_agg(chr(0) || relative_path || chr(0) || content_hash, '' ORDER BY relative_path)), 32) AS generation_id, count(*)::INT AS n_files FROM {source} GROUP BY repository_id"


GENERATIONS = generation_sql(HASHED)


@query(GENERATIONS)
def m5_generation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.generation_ids(hashed(spark, sf_dir), VERSIONS)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, n = staged(hashed(spark, sf_dir), "hashed"), F.col("doc_id")
    edited = F.when(n % 7 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash"))
    return rows.filter(n % 13 != 0), rows.filter(n % 11 != 0).withColumn("content_hash", edited)


DIFF = f"""
old AS (SELECT * FROM {HASHED} WHERE doc_id % 13 <> 0),
new AS (SELECT repository_id, relative_path, CASE WHEN doc_id % 7 = 0 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash FROM {HASHED} WHERE doc_id % 11 <> 0),
diff AS (SELECT coalesce(old.repository_id, new.repository_id) AS repository_id, coalesce(old.relative_path, new.relative_path) AS relative_path,
  CASE WHEN old.content_hash IS NULL THEN 'added' WHEN new.content_hash IS NULL THEN 'removed' WHEN old.content_hash = new.content_hash THEN 'unchanged' ELSE 'modified' END AS change
  FROM old FULL JOIN new ON old.repository_id = new.repository_id AND old.relative_path = new.relative_path)"""


@query(f"WITH {DIFF} SELECT * FROM diff")
def m6_diff_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff_manifests(*_two(spark, sf_dir))


@query(IDS + f""", {DIFF}
SELECT repository_id, relative_path, NULL::VARCHAR AS chunk_id, 'rechunk' AS action FROM diff WHERE change IN ('added', 'modified')
UNION ALL SELECT i.repository_id, i.relative_path, chunk_id, CASE WHEN change = 'unchanged' THEN 'reuse' ELSE 'delete' END FROM ids i LEFT JOIN diff d ON d.repository_id = i.repository_id AND d.relative_path = i.relative_path""")
def m7_plan_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.plan_refresh(manifest.diff_manifests(*_two(spark, sf_dir)), identified(spark, sf_dir).select("repository_id", "relative_path", "chunk_id"))


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repository_id"), F.col("o_orderkey").cast("string").alias("generation_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at_ms"))


@query("""WITH g AS (SELECT o_custkey::VARCHAR AS repository_id, o_orderkey::VARCHAR AS generation_id, o_orderdate AS made FROM orders)
SELECT repository_id, arg_max(generation_id, (made, generation_id)) AS generation_id FROM g GROUP BY repository_id
UNION SELECT repository_id, generation_id FROM g WHERE generation_id IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_quantity > 49)""")
def m8_retain_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").cast("string").alias("generation_id"))
    return manifest.retained_generations(_generations(spark, sf_dir), refs)


@query("""WITH g AS (SELECT o_custkey::VARCHAR AS repository_id, o_orderkey::VARCHAR AS generation_id, o_orderdate AS made FROM orders),
kept AS (SELECT repository_id, arg_max(generation_id, (made, generation_id)) AS generation_id FROM g GROUP BY repository_id
  UNION SELECT repository_id, generation_id FROM g WHERE generation_id IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_quantity > 49)),
n AS (SELECT l_partkey AS chunk_id, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey::VARCHAR IN (SELECT generation_id FROM kept) GROUP BY 1)
SELECT DISTINCT p_partkey AS chunk_id, coalesce(n, 0) AS n_references, CASE WHEN n > 0 THEN 'keep' ELSE 'drop' END AS action FROM part LEFT JOIN n ON chunk_id = p_partkey""")
def m8_mark_and_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are generations, their lines' parts the chunks that a manifest lists, all parts what is stored."""
    line = table(spark, sf_dir, "lineitem")
    generations_, refs = _generations(spark, sf_dir), line.filter("l_quantity > 49").select(F.col("l_orderkey").cast("string").alias("generation_id"))
    lists = line.groupBy(F.col("l_orderkey").cast("string").alias("generation_id")).agg(F.collect_set("l_partkey").alias("chunk_ids"))
    manifests = generations_.join(lists, "generation_id")
    references = manifest.chunk_references(manifests, manifest.retained_generations(generations_, refs))
    return manifest.sweep(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id")), references)


@query(f"""WITH a AS ({GENERATIONS}), b AS ({generation_sql(f"(SELECT repository_id, relative_path, CASE WHEN doc_id % 97 = 3 THEN 'other' ELSE content_hash END AS content_hash FROM {HASHED})")})
SELECT a.repository_id, a.generation_id = b.generation_id AS same FROM a JOIN b ON a.repository_id = b.repository_id""")
def m9_check_generation_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    again = rows.repartition(5).withColumn("content_hash", F.when(F.col("doc_id") % 97 == 3, F.lit("other")).otherwise(F.col("content_hash")))
    return manifest.check_determinism(manifest.generation_ids(rows, VERSIONS), manifest.generation_ids(again, VERSIONS))


def _dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover(listing(spark, sf_dir), LIMITS)


@query(f"WITH {DISCOVER} SELECT origin, count(*) AS n FROM discovered WHERE status = 'skipped' GROUP BY origin")
def a1_skipped_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.skipped_by_origin(_dispositions(spark, sf_dir))


@query(f"WITH {DISCOVER} SELECT language, count(*) AS n FROM discovered WHERE status = 'indexable' GROUP BY language")
def a2_indexed_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.indexed_by_language(_dispositions(spark, sf_dir).filter("status = 'indexable'"))


INGEST = f"""{DISCOVER},
ingested AS MATERIALIZED (
  SELECT repository_id, relative_path, language, truncated, CASE WHEN d_status = 'skipped' THEN 'skipped' WHEN {_MINIFIED} THEN 'minified' ELSE 'indexed' END AS status, {REDACTED} AS text
  FROM (SELECT d.repository_id, d.relative_path, d.language, d.truncated, d.status AS d_status, l.text FROM discovered d LEFT JOIN lrows l ON l.repository_id = d.repository_id AND l.relative_path = d.relative_path)),
{file_chunk_sql("(SELECT relative_path, language, text FROM ingested WHERE status = 'indexed')")},
per_file AS (SELECT relative_path, count(*) AS n, sum(estimated_tokens) AS k FROM file_chunks GROUP BY relative_path)"""


@query(f"""WITH RECURSIVE {INGEST},
r AS (SELECT repository_id, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped') AS skipped, 0::BIGINT AS unreadable, count(*) FILTER (status = 'minified') AS minified,
      coalesce(sum(n), 0)::BIGINT AS chunks, coalesce(sum(k), 0)::BIGINT AS tokens, bool_or(truncated IS NOT NULL) AS truncated FROM ingested LEFT JOIN per_file USING (relative_path) GROUP BY repository_id)
SELECT r.*, generation_id FROM r LEFT JOIN ({generation_sql("(SELECT repository_id, relative_path, sha256(text) AS content_hash FROM ingested WHERE status = 'indexed')")}) USING (repository_id)""")
def a3_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: discover, read, filter, redact, chunk, hash and summarise every repository."""
    read, chunks = discovery.ingest(listing(spark, sf_dir), LIMITS, CHUNKING)
    summary = reports.corpus_summary(read.select("repository_id", "relative_path", "status", "truncated"), chunking.file_token_totals(chunks))
    return summary.join(manifest.generation_ids(read.filter("status = 'indexed'"), VERSIONS).select("repository_id", "generation_id"), "repository_id", "left")


@query(f"SELECT relative_path, n FROM (SELECT string_split(relative_path, '.')[-1] AS relative_path, count(*) AS n FROM {FILES} GROUP BY 1) ORDER BY n DESC, relative_path LIMIT 5")
def a4_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = files(spark, sf_dir).groupBy(F.substring_index("relative_path", ".", -1).alias("relative_path")).agg(F.count(F.lit(1)).alias("n"))
    return reports.top_counts(counts, "relative_path", 5)


@query(f"SELECT repository_id, relative_path FROM {FILES} ORDER BY repository_id, relative_path LIMIT 15")
def a5_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_rows(files(spark, sf_dir).select("repository_id", "relative_path"))


@query(f"""WITH {DISCOVER}
SELECT repository_id, sum(n)::BIGINT AS seen, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS indexed, coalesce(string_agg(reason || '=' || n, ';' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS excluded, bool_and(cut IS NULL AND NOT lost) AS complete
FROM (SELECT repository_id, reason, count(*) AS n, max(truncated) AS cut, coalesce(reason = '{discovery.UNREADABLE}', false) AS lost FROM discovered GROUP BY ALL) GROUP BY repository_id""")
def a6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(_dispositions(spark, sf_dir))


# ---- secrets

FINDINGS = f"(SELECT repository_id, relative_path, i AS line_no, rule FROM (SELECT repository_id, relative_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM {FILES}), (VALUES " + ", ".join(f"('{n}', '{p}')" for n, (p, _) in RULE_SQL.items()) + ") AS r(rule, pattern) WHERE regexp_matches(line, pattern))"


@query(f"SELECT doc_id, sha256({REDACTED}) AS digest, len(string_split({REDACTED}, chr(10))) AS n_lines FROM documents")
def r1_redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.redact_secrets(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(out, 256).alias("digest"), F.size(F.split(out, "\n", -1)).cast("long").alias("n_lines"))


@query(f"SELECT * FROM {FINDINGS}")
def r2_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(files(spark, sf_dir))


@query(f"SELECT repository_id, rule, count(*) AS n FROM {FINDINGS} GROUP BY ALL")
def r3_secret_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_summary(secrets.secret_findings(files(spark, sf_dir)))


# ---- sources and sinks

@query("SELECT doc_id, length(text) AS n, sha256(text) AS digest FROM documents WHERE doc_id % 6 <> 1 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 6 = 1")
def s2_read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.encode(F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("\0"), "text")).otherwise(F.col("text")), "UTF-8")
    read = repo_tree.read_text_files(docs.select("doc_id", content.alias("content")))
    return read.select("doc_id", F.char_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query(f"SELECT '{{\"repository_id\":\"' || repository_id || '\",\"files\":' || count(*) || ',\"bytes\":' || sum(size_bytes)::BIGINT || '}}' AS summary FROM {HASHED} GROUP BY repository_id")
def s5_write_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written as JSON and its lines read back."""
    path = scratch(spark, "summary")
    generations.write_summary_json(hashed(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")), path)
    return spark.read.text(path).withColumnRenamed("value", "summary")


@query(f"WITH g AS ({GENERATIONS}) SELECT h.repository_id, g.generation_id, h.relative_path, h.content_hash FROM {HASHED} h JOIN g ON g.repository_id = h.repository_id WHERE h.repository_id <> 'src3'")
def s4_write_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all repositories in one partitioned write each of manifest, chunks and exclusions, and publishes all but one; readers see the published ones."""
    path = scratch(spark, "generations")
    rows = staged(hashed(spark, sf_dir), "hashed")
    ids = staged(manifest.generation_ids(rows, VERSIONS), "generation-ids")
    excluded = _dispositions(spark, sf_dir).filter("status = 'skipped'").select("repository_id", "relative_path", "reason", "origin")
    made = F.crc32(F.encode("repository_id", "UTF-8"))
    stamps = ids.select("repository_id", "generation_id", made.alias("created_at_ms"))
    generations.write_generations(path, stamps, rows.select("repository_id", "relative_path", "content_hash", "size_bytes"), identified(spark, sf_dir).select("repository_id", "relative_path", "chunk_id", "start_line", "end_line"), excluded, stamps.filter("repository_id <> 'src3'"))
    return generations.read_generation(spark, path, "manifest").select("repository_id", "generation_id", "relative_path", "content_hash")


@query("SELECT source AS repository_id, doc_id || '.txt' AS relative_path, 'file' AS entry_type, strlen(text)::BIGINT AS size_bytes, sha256(text) AS digest FROM documents UNION ALL SELECT DISTINCT source, 'part' || doc_id % 4, 'dir', NULL, NULL FROM documents".replace("doc_id || '.txt'", "'part' || doc_id % 4 || '/' || doc_id || '.txt'"))
def s1_read_repo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by the tasks as files of a folder per repository on the shared file system, and listed again with their content."""
    root = scratch(spark, "tree").removeprefix("file:")
    docs = files(spark, sf_dir).select("repository_id", F.concat(F.lit("part"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), "text")
    written = repo_tree.write_tree(docs, root)
    roots = {r.repository_id: f"{root}/{r.repository_id}" for r in written.select("repository_id").distinct().collect()}
    tree = repo_tree.read_repo_tree(spark, roots, max_bytes=1 << 30)
    return tree.select("repository_id", "relative_path", "entry_type", "size_bytes", TX.hash_bytes(F.col("content")).alias("digest"))


@query(f"""WITH {LISTING},
wf AS (SELECT repository_id, relative_path, size_bytes FROM listing WHERE entry_type = 'file'),
wd AS (SELECT DISTINCT repository_id, array_to_string(string_split(relative_path, '/')[:k], '/') AS relative_path FROM (SELECT repository_id, relative_path, unnest(range(1, len(string_split(relative_path, '/')))) AS k FROM wf)),
w AS (SELECT repository_id, relative_path, 'file' AS entry_type, size_bytes FROM wf UNION ALL SELECT repository_id, relative_path, 'dir', NULL FROM wd)
SELECT * FROM w WHERE NOT starts_with(relative_path, 'node_modules/') AND NOT starts_with(relative_path, 'build1/')""")
def s1_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's files written as trees and walked: directories that rules or defaults drop are rows without any below them."""
    root = scratch(spark, "tree").removeprefix("file:")
    written = repo_tree.write_tree(listing(spark, sf_dir).filter("entry_type = 'file'").select("repository_id", "relative_path", "text"), root)
    roots = {r.repository_id: f"{root}/{r.repository_id}" for r in written.select("repository_id").distinct().collect()}
    return walk.walk(spark, roots, LIMITS).select("repository_id", "relative_path", "entry_type", "size_bytes")
