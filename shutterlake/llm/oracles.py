"""SQL for the rows of those queries that SQL can express; documents have distinct ids."""

from __future__ import annotations

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS gram FROM e),
d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g WHERE i + 19 <= n),
m AS (SELECT e.doc_id, e.i, e.word, max(CASE WHEN d.k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM e LEFT JOIN d ON d.doc_id = e.doc_id AND d.i = e.i)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(s.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN (SELECT doc_id, sum(gone) AS gone, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM m GROUP BY doc_id) s ON s.doc_id = w.doc_id
"""

MIX = f"""
WITH r AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source) s),
l AS (SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM w),
v AS (SELECT arg_min(lv, ratio) AS lv FROM l WHERE lv * weight <= 2 * source_size),
t AS (SELECT l.source, l.source_size, least(CAST(2 * l.source_size AS DOUBLE), coalesce(v.lv * l.weight, CAST(2 * l.source_size AS DOUBLE))) AS target FROM l CROSS JOIN v),
c AS (SELECT r.doc_id, r.k, r.size, t.source_size, t.target, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id ROWS UNBOUNDED PRECEDING) AS run FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, k, size, run / target AS f FROM c WHERE size > 0 UNION ALL SELECT doc_id, k, size, (source_size + run) / target AS f FROM c WHERE size > 0),
z AS (SELECT doc_id, size, sum(size) OVER (ORDER BY f, k ROWS UNBOUNDED PRECEDING) AS spent FROM q)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(y.taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM z WHERE spent <= (SELECT floor(CAST(1.5 AS DOUBLE) * sum(size)) FROM r) GROUP BY doc_id) y ON y.doc_id = c.doc_id
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), 
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(na.n) + max(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""

# The checksum of a decimal id, bit by bit.
CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"

TRIE = f"""
WITH t AS (SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, CAST(length(coalesce(text, '')) AS BIGINT) AS len FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
c AS (SELECT *, least(h, lead_size) AS k, least(h, lead_size) + greatest(size - h, 0) AS n FROM (SELECT s.conv_id, s.size, {CRC.replace("conv_id", "s.conv_id")} % 6 AS h, coalesce(l.size, 0) AS lead_size
  FROM (SELECT conv_id, count(*) AS size FROM o GROUP BY conv_id) s LEFT JOIN (SELECT conv_id, count(*) AS size FROM o GROUP BY conv_id) l ON l.conv_id = s.conv_id - s.conv_id % 100) q),
r AS (SELECT c.conv_id, c.n, o.pos AS d, o.k, o.len FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h UNION ALL SELECT c.conv_id, c.n, c.k + o.pos - c.h, o.k, o.len FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
p AS (SELECT conv_id, n, d, len, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, n, 0, 0, '' FROM c),
v AS (SELECT path, d, count(*) AS n_convs, min(conv_id) AS conv_id, (count(*) - 1) * max(len) AS own, max(n) = d AS leaf FROM p GROUP BY path, d),
s AS (SELECT node, sum(own) AS saved, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves FROM (SELECT left(path, 32 * unnest(range(0, d + 1))) AS node, own, leaf FROM v) a GROUP BY node),
b AS (SELECT left(path, 32 * (d - 1)) AS node, count(*) AS n FROM v WHERE d > 0 GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p WHERE d = n GROUP BY path)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(b.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN s ON s.node = v.path LEFT JOIN b ON b.node = v.path LEFT JOIN e ON e.path = v.path LEFT JOIN v u ON v.d > 0 AND u.path = left(v.path, 32 * (v.d - 1))
"""

AUDIT = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(g.good, 0) AS good, coalesce(g.toxic, 0) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > w.first, false)] AS bad FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
m AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bad),
l AS (SELECT i, chr(CAST(64 + i AS INTEGER)) AS c FROM range(1, 6) x(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS fs FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, fs, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT m.part, s.filter_order, s.step, s.fs[s.step] AS i, m.n, m.good, m.toxic, m.bad[s.fs[s.step]] AS fails, list_contains(list_transform(s.fs[1:s.step - 1], lambda k: m.bad[k]), true) AS before, len(list_filter(m.bad, lambda k: k)) AS n_bad FROM m, s),
y AS (SELECT part, filter_order, step, i, sum(CASE WHEN NOT before AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT before AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN before AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND n_bad = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT before AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT before AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY part, filter_order, step, i)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM y
"""

SQL = {"op3_recompress": REPEATS, "op7_fair_mix": MIX, "op9_gram_join": NEAR, "op11_prefix_trie": TRIE, "op13_filter_audit": AUDIT}
