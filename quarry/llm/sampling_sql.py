"""DuckDB SQL of the sampling and trie queries."""

from __future__ import annotations

#: crc32 of a string of ASCII characters, a bit at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"

OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
      sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, cap * rest <= weight * (budget - before) AS filled FROM l),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (filled) OVER (), 0.0)) / sum(weight) FILTER (NOT filled) OVER () END AS target,
      ('0x' || left(sha256('42' || coalesce(':' || source, '')), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST)::DOUBLE AS n FROM d)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE * n + u) - floor(target / source_size::DOUBLE * (n - 1) + u) ELSE 0 END)::BIGINT * size AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""

#: A feature's checksum is the exclusive or of what each byte becomes after the bytes behind it, by a table (byte, bytes behind).
OP12_SQL = r"""
WITH RECURSIVE
d AS (SELECT 1 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
f AS MATERIALIZED (
  SELECT side, id, gram, count(*) AS n FROM (
    SELECT side, id, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM (SELECT side, id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (VALUES (1), (2), (3)) AS runs(k) WHERE len(ws) >= k)) GROUP BY ALL),
g AS MATERIALIZED (SELECT gram, hex(encode(gram)) AS h, strlen(gram) AS size FROM (SELECT DISTINCT gram FROM f)),
step AS MATERIALIZED (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) AS t(b)),
behind AS (SELECT b, 0 AS k, v FROM step UNION ALL SELECT x.b, x.k + 1, xor(x.v >> 8, s.v) FROM behind x JOIN step s ON s.b = x.v & 255 WHERE x.k < (SELECT max(size) FROM g)),
init AS (SELECT 0 AS k, 4294967295::BIGINT AS v UNION ALL SELECT x.k + 1, xor(x.v >> 8, s.v) FROM init x JOIN step s ON s.b = x.v & 255 WHERE x.k < (SELECT max(size) FROM g)),
bytes AS (SELECT gram, size, size - p AS k, ('0x' || h[2 * p - 1:2 * p])::BIGINT AS b FROM (SELECT *, unnest(range(1, size + 1)) AS p FROM g)),
crc AS (SELECT y.gram, xor(xor(bit_xor(t.v), any_value(i.v)), 4294967295) AS c FROM bytes y JOIN behind t ON t.b = y.b AND t.k = y.k JOIN init i ON i.k = y.size GROUP BY y.gram),
fb AS MATERIALIZED (SELECT side, id, c % 10000 AS bucket, sum(n) AS n FROM f JOIN crc USING (gram) GROUP BY ALL),
all_s AS (SELECT coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 2), 0)::DOUBLE AS t FROM fb),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 2), 0)::DOUBLE + 1) * ((SELECT s FROM all_s) + 10000) / ((coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE + 1) * ((SELECT t FROM all_s) + 10000))))::BIGINT AS gain FROM fb GROUP BY bucket),
weighed AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE side = 1 GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || id), 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weighed USING (id) WHERE side = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank FROM ranked
"""

OP13_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {crc} % 9 AS h FROM t),
parts AS (
  SELECT c.conv_id, 0 AS own, k, role, text FROM c JOIN t ON t.conv_id = c.base AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
seqs AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY own, k) FILTER (k IS NOT NULL), []) AS seq FROM c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d AS depth, seq[1:d] AS node, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(strlen(node[depth].text), 0) AS saved
  FROM prefixes GROUP BY node, depth),
up AS (SELECT node, node[1:depth - 1] AS parent FROM nodes WHERE depth > 0),
kids AS (SELECT parent, count(*) AS n_children FROM up GROUP BY parent),
below AS (SELECT a.node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM (SELECT n.node, n.saved, n_children, unnest(range(0, n.depth + 1)) AS d FROM nodes n LEFT JOIN kids ON kids.parent = n.node) a GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN kids ON kids.parent = n.node LEFT JOIN up ON up.node = n.node LEFT JOIN nodes p ON p.node = up.parent
""".format(crc=_CRC.format("conv_id::VARCHAR"))
