"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, convtrie, forest, jpeg, licenses, mixing, neardup, pieces, quality, secrets, substrings, suffixes, tokenfiles

QUERIES = {
    "op1_secret_scans": secrets.op1,
    "op2_quality": quality.op2,
    "op3_sentencepiece": pieces.op3,
    "op4_mix_sources": mixing.op4,
    "op5_near_duplicates": neardup.op5,
    "op6_media_columns": jpeg.op6,
    "op7_substring_dedup": substrings.op7,
    "op8_token_files": tokenfiles.op8,
    "op9_nearest_neighbours": forest.op9,
    "op10_license_scans": licenses.op10,
    "op11_suffix_dedup": suffixes.op11,
    "op12_conversation_trie": convtrie.op12,
    "op13_tokenizer_alignment": alignment.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
s AS (SELECT g.doc_id, list(g.i) AS starts FROM g JOIN f ON g.k = f.k WHERE g.doc_id > f.first GROUP BY g.doc_id),
u AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda x: range(x, x + 50)))) AS gone FROM s),
e AS (SELECT d.doc_id, d.w, coalesce(u.gone, []) AS gone FROM d LEFT JOIN u ON d.doc_id = u.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
 sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM e""",
    "op12_conversation_trie": r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
h AS (SELECT c, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END)), 4294967295) % 9 AS BIGINT) AS h FROM ids),
b AS (SELECT h.c, t.i, t.r, t.x FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.i <= h.h UNION ALL SELECT h.c, t.i + 1000000, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
k AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, md5(strlen(r) || ':' || r || ':' || x) AS k, strlen(x) AS w FROM b),
l AS (SELECT h.c, coalesce(g.ks, []) AS ks, coalesce(g.ws, []) AS ws FROM h LEFT JOIN (SELECT c, list(k ORDER BY d) AS ks, list(w ORDER BY d) AS ws FROM k GROUP BY c) g ON g.c = h.c),
p AS (SELECT c, len(ks) AS n, ws, ks, unnest(range(0, len(ks) + 1)) AS d FROM l),
q AS (SELECT c, n, d, md5(array_to_string(ks[1:d], ',')) AS s, CASE WHEN d = 0 THEN NULL ELSE md5(array_to_string(ks[1:d - 1], ',')) END AS ps, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w FROM p),
v AS (SELECT s, d, ps, any_value(w) AS w, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM q GROUP BY s, d, ps),
e AS (SELECT ps AS s, d - 1 AS d, count(*) AS kids FROM v WHERE d > 0 GROUP BY ps, d),
n AS (SELECT v.*, coalesce(e.kids, 0) AS kids FROM v LEFT JOIN e ON e.s = v.s AND e.d = v.d),
u AS (SELECT DISTINCT q.s, q.d, a.s AS anc, a.d AS ad FROM q JOIN q a ON a.c = q.c AND a.d <= q.d),
z AS (SELECT u.anc, u.ad, sum(CASE WHEN n.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.w) AS saved FROM u JOIN n ON n.s = u.s AND n.d = u.d GROUP BY u.anc, u.ad)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n AS n_convs, CAST(n.kids AS BIGINT) AS n_children,
 CAST(z.leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN z ON z.anc = n.s AND z.ad = n.d LEFT JOIN v m ON m.s = n.ps AND m.d = n.d - 1""",
}
