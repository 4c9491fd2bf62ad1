"""DuckDB SQL that checks the queries of operators 11 to 13."""

from __future__ import annotations

# unsigned crc32 of a string: DuckDB has none
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS tab)"


def _crc32(text: str) -> str:
    raw = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({raw}, lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1]), 4294967295), 4294967295)"


OP11 = rf"""
WITH {CRC_TABLE}, o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32('conv_id::VARCHAR')} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc
), r AS (
  SELECT c.conv_id, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.p <= c.h
  UNION ALL SELECT c.conv_id, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(string_agg(md5(length(role) || '/' || role || text), '') OVER w) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), paths AS (
  SELECT conv_id, 0 AS d, 0 AS words, '' AS node FROM c UNION ALL SELECT * FROM s
), n AS (
  SELECT node, min(conv_id) AS member, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(words) AS own FROM paths GROUP BY node
), f AS (
  SELECT n.*, a.node AS parent FROM n LEFT JOIN paths a ON a.conv_id = n.member AND a.d = n.depth - 1
), k AS (
  SELECT f.*, coalesce(x.m, 0) AS n_children FROM f LEFT JOIN (SELECT parent, count(*) AS m FROM f GROUP BY parent) x ON x.parent = f.node
), sums AS (
  SELECT a.node, sum(k.own)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM k JOIN paths a ON a.conv_id = k.member AND a.d <= k.depth GROUP BY a.node
), e AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, arg_max(node, d) AS node FROM paths GROUP BY conv_id) GROUP BY node
)
SELECT k.member AS conv_id, k.depth::BIGINT AS depth, p.member AS parent_conv_id, k.n_convs, k.n_children, sums.n_leaves, sums.saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM k JOIN sums USING (node) LEFT JOIN n p ON p.node = k.parent LEFT JOIN e ON e.node = k.node
"""

OP13 = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc WHERE length(run) >= 5
), w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n AS n2 FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cuts a JOIN w ON w.word = a.cut
  UNION SELECT w.word, a.word, a.n FROM cuts a JOIN w ON w.word = a.cut
), best AS (
  SELECT word, count(*) AS n_near, min((-n2, other)) AS b FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
  FROM w LEFT JOIN best USING (word)
), ahead AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT a.word, f.word, f.form FROM ahead a JOIN forms f ON f.word = a.next
)
SELECT f.word, f.form, a.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN ahead a ON a.word = f.word AND a.next IS NULL
"""

OP12 = r"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents
), p AS MATERIALIZED (
  SELECT r, doc_id, i, md5(array_slice(x, i + 1, i + 50)) AS s FROM (SELECT *, unnest(range(octet_length(x) - 49)) AS i FROM t)
), least AS (SELECT s, min(doc_id) AS d FROM p GROUP BY s HAVING min(doc_id) <> max(doc_id)
), gone AS (SELECT p.r, p.i FROM p JOIN least USING (s) WHERE p.doc_id > least.d
), runs AS (
  SELECT r, min(i) AS a, max(i) + 50 AS z
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, CASE WHEN i - lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) > 50 THEN 1 ELSE 0 END AS new FROM gone)) GROUP BY r, k
), kept AS (
  SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(hex(array_slice(x, upto + 1, a)), '' ORDER BY a) AS head, max(z) AS z
  FROM (SELECT *, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS upto FROM runs) JOIN t USING (r) GROUP BY r
)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN z IS NULL THEN x ELSE unhex(head || hex(array_slice(x, z + 1, octet_length(x)))) END) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
