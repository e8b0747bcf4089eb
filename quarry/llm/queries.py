"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shipped
from . import bpe, chat_format, decontaminate, exact_dedup, language_id, line_dedup, mixing, near_dedup, pii, prefix_trie, quality, resampling, suffix_dedup
from .common import staged
from .sampling_sql import OP11_SQL, OP12_SQL, OP13_SQL

#: The control-laden conversation that the contract adds.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False, with_text=False)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    talks = talks.union(spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string"))
    return chat_format.read_back(chat_format.format_turns(talks))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))))
    return out.select("doc_id", "n_units", "n_removed", spans.alias("removed_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.copies(staged(sizes, "sizes"), F.col("size"))  # a range shuffle reads its input twice
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in (op1_exact_dedup, op2_suffix_array_dedup, op3_bpe, op4_chat_format, op5_decontaminate, op6_quality, op7_language_id, op8_pii, op9_line_dedup, op10_minhash, op11_mix_sources, op12_importance_resampling, op13_prefix_trie, pipeline)}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256
FROM d
"""

_ESCAPE = "replace(coalesce({0}, ''), chr(92), chr(92) || chr(92))"
for _mark in chat_format.DEFAULT.controls:
    _ESCAPE = f"replace({_ESCAPE}, '{_mark}', '{_mark[0]}' || chr(92) || '{_mark[1:]}')"

OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length({_ESCAPE.format("text")}) + CASE role WHEN 'system' THEN 22 WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 ELSE 20 + length({_ESCAPE.format("role")}) END AS size,
         lag(role, 1, '^') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       sum(CASE WHEN role = 'system' AND prev = '^' OR role = 'user' AND prev IN ('^', 'system', 'assistant') OR role = 'assistant' AND prev = 'user' THEN 0 ELSE 1 END)::BIGINT AS out_of_order
FROM f GROUP BY conv_id
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM bw)),
dg AS (
  SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw))),
h AS (SELECT dg.doc_id, iw.item_id, dg.p, dg.size FROM dg JOIN iw USING (size, gram)),
w AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, size)) AS k FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id),
ti AS (SELECT item_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS off, len(terms) AS n, least(10, len(terms)) AS size FROM (SELECT item_id, regexp_extract_all(lower(replace(coalesce(text, ''), 'Σ', 'σ')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM benchmark)),
td AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), 'Σ', 'σ')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents)) WHERE term IN (SELECT term FROM ti)),
cf AS (SELECT term, count(*) AS cf FROM td GROUP BY term),
wi AS (SELECT item_id, s, term, coalesce(cf, 0) AS cf, row_number() OVER (PARTITION BY item_id, s ORDER BY coalesce(cf, 0), off) AS k FROM (SELECT *, unnest(range(greatest(0, off - size + 1), least(off, n - size) + 1)) AS s FROM ti) LEFT JOIN cf USING (term)),
two AS (SELECT item_id, s, max(term) FILTER (k = 1) AS t1, max(cf) FILTER (k = 1) AS c1, coalesce(max(term) FILTER (k = 2), max(term) FILTER (k = 1)) AS t2 FROM wi WHERE k <= 2 GROUP BY item_id, s),
best AS (SELECT item_id, arg_min(t1, (c1, s)) AS t1, arg_min(t2, (c1, s)) AS t2 FROM two WHERE c1 > 0 GROUP BY item_id),
nr AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT a.doc_id, item_id FROM best JOIN td a ON a.term = t1 JOIN td b ON b.doc_id = a.doc_id AND b.term = t2 AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 10) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_near, 0) AS n_near, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_chat_format": OP4_SQL, "op5_decontaminate": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_mix_sources": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_prefix_trie": OP13_SQL}


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{line}') AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) AS line FROM d),
n AS (SELECT *, trim(regexp_replace(lower(body), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS norm, regexp_extract_all(body, '{unit}') AS pieces FROM l),
w AS (SELECT doc_id, line, pieces, length(norm) AS line_size, length(norm) > 0 AND row_number() OVER (PARTITION BY sha256(norm) ORDER BY doc_id, line) > 1 AS whole FROM n),
u AS (SELECT doc_id, line, line_size, whole, unnest(pieces) AS body, generate_subscripts(pieces, 1) AS piece FROM w),
v AS (SELECT *, trim(regexp_replace(lower(body), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY line, piece) AS unit FROM u),
p AS (SELECT *, length(norm) > 0 AND row_number() OVER (PARTITION BY sha256(norm) ORDER BY doc_id, line, piece) > 1 AS part, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY unit)::BIGINT AS stop FROM v),
i AS (SELECT *, whole OR part AS later, unit - row_number() OVER (PARTITION BY doc_id, whole OR part ORDER BY unit) AS island FROM p),
g AS (SELECT *, whole OR (later AND sum(CASE WHEN whole AND piece = 1 THEN line_size WHEN whole THEN 0 ELSE length(norm) END) OVER (PARTITION BY doc_id, later, island) >= {min_run}) AS gone FROM i),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id, gone ORDER BY unit) AS run FROM g),
s AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM (SELECT doc_id, run, min(stop - length(body)) AS a, max(stop) AS b FROM r WHERE gone GROUP BY doc_id, run) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(body, '' ORDER BY unit) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
""".replace("{unit}", line_dedup.unit_pattern(line_dedup.MIN_UNIT)).replace("{line}", line_dedup.LINE).replace("{min_run}", str(line_dedup.MIN_RUN))
