"""The same results in SQL, for tables small enough to compare every pair."""

JACCARD_SQL = r"""
WITH RECURSIVE said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM said),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.low AS component_id FROM sets s JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) m USING (doc_id)"""

WARC_SQL = r"""
WITH sized AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, i * 5 + 1, 5) AS BIGINT)) AS fives FROM sized),
named AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) % 32 AS INTEGER) + 1, 1)), '') AS payload_digest FROM bits),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM held"""

#: edges between absolute URLs only; link targets of other kinds are tested against a brute-force version
URL_SQL = r"""
WITH RECURSIVE parted AS (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']), {'host': '', 'path': '', 'query': ''}) AS u, url LIKE '%://%' AS linked FROM pages),
spelt AS (SELECT page_id, html, linked, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path, u.query AS query FROM parted),
keyed AS (SELECT *, CASE WHEN linked THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS key FROM spelt),
rules(verdict, rule, host, path) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
targets AS (SELECT key AS a, regexp_extract(regexp_extract(html, '(?i)<link[^>]*rel="?canonical[^>]*>'), '(?i)href="?[^":/]*://([^"# >]*)', 1) AS b FROM keyed WHERE regexp_matches(html, '(?i)<link[^>]*rel="?canonical')),
edges AS (SELECT DISTINCT a, b FROM targets WHERE b <> '' AND a IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
nodes AS (SELECT node, regexp_extract(node, '^[^/]*') AS host, regexp_extract(node, '^[^/]*([^?]*)', 1) AS path FROM (SELECT DISTINCT a AS node FROM both_ways)),
judged AS (SELECT n.node, arg_max(r.verdict, length(r.rule)) AS verdict FROM nodes n JOIN rules r ON (n.host = r.host OR suffix(n.host, '.' || r.host)) AND prefix(n.path, r.path) GROUP BY n.node),
blocked AS (SELECT DISTINCT r.node FROM reach r JOIN judged j ON r.other = j.node AND j.verdict = 'block'),
ruled AS (SELECT k.page_id, k.host, k.path, k.key, max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.verdict)) AS best
  FROM (SELECT *, row_number() OVER () AS row_no FROM keyed) k LEFT JOIN rules r ON (k.host = r.host OR suffix(k.host, '.' || r.host)) AND prefix(k.path, r.path) GROUP BY k.row_no, k.page_id, k.host, k.path, k.key)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, best.verdict IS NULL AND b.node IS NOT NULL AS alias
FROM ruled LEFT JOIN blocked b ON ruled.key = b.node"""

#: Lloyd's rounds written out: all distances, the nearest, the floors of the means
KMEANS_SQL = r"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
seeds AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM (SELECT vec_id, min(q) AS q FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id) ORDER BY sha256('1:' || vec_id) LIMIT 16),
a1 AS (SELECT rid, vec_id, q, c, d FROM (SELECT k.rid, k.vec_id, k.q, s.c, list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
  row_number() OVER (PARTITION BY k.rid ORDER BY list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), s.c) AS best FROM kept k CROSS JOIN seeds s) WHERE best = 1),
p1 AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a1) GROUP BY c, i),
m1 AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM p1 GROUP BY c),
c1 AS (SELECT s.c, coalesce(m.q, s.q) AS q FROM seeds s LEFT JOIN m1 m ON s.c = m.c),
a2 AS (SELECT rid, vec_id, q, c, d FROM (SELECT k.rid, k.vec_id, k.q, s.c, list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
  row_number() OVER (PARTITION BY k.rid ORDER BY list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), s.c) AS best FROM kept k CROSS JOIN c1 s) WHERE best = 1),
p2 AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a2) GROUP BY c, i),
m2 AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM p2 GROUP BY c),
c2 AS (SELECT s.c, coalesce(m.q, s.q) AS q FROM c1 s LEFT JOIN m2 m ON s.c = m.c),
a3 AS (SELECT rid, vec_id, q, c, d FROM (SELECT k.rid, k.vec_id, k.q, s.c, list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
  row_number() OVER (PARTITION BY k.rid ORDER BY list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), s.c) AS best FROM kept k CROSS JOIN c2 s) WHERE best = 1),
p3 AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a3) GROUP BY c, i),
m3 AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM p3 GROUP BY c),
c3 AS (SELECT s.c, coalesce(m.q, s.q) AS q FROM c2 s LEFT JOIN m3 m ON s.c = m.c),
a4 AS (SELECT rid, vec_id, q, c, d FROM (SELECT k.rid, k.vec_id, k.q, s.c, list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
  row_number() OVER (PARTITION BY k.rid ORDER BY list_sum(list_transform(list_zip(k.q, s.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), s.c) AS best FROM kept k CROSS JOIN c3 s) WHERE best = 1)
SELECT vec_id, CAST(a4.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a4.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256 FROM a4 JOIN c3 ON a4.c = c3.c"""

#: edits chosen turn by turn from the end, with the repaired text carried along
REPAIR_SQL = r"""
WITH RECURSIVE
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
marks AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: CAST(unicode(key[i]) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT) % 20 AS mark
  FROM (SELECT DISTINCT key FROM keyed)),
hit AS (SELECT conv_id, turn, mark, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
  CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM keyed JOIN marks USING (key) WHERE mark <> 0),
turns AS (SELECT conv_id, turn, role, text FROM hit UNION ALL SELECT conv_id, turn, role, text FROM hit WHERE mark = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM turns),
judged AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS init, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
told AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
ins(s, t, k, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:'),
  (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
go(s, init, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
own(s, t, k, letter, init, name) AS (
  SELECT s, s, 3, 'D', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM (VALUES (0), (1), (2), (3)) v(s) UNION ALL SELECT s, t, 0, 'K', init, NULL FROM go
  UNION ALL SELECT s, t, 2, 'R', NULL, CASE init WHEN 'u' THEN 'user' ELSE 'assistant' END FROM go WHERE init <> 's'),
ways AS (SELECT ins.s, own.t, ins.k + own.k AS k, ins.letters || own.letter AS letters, own.letter, ins.lines, own.init, own.name FROM ins JOIN own ON ins.t = own.s),
best(conv_id, i, s, w) AS (
  SELECT * FROM (SELECT conv_id, n AS i, s, min({'cost': CAST(k AS BIGINT), 'audit': letters, 'said': lines}) AS w FROM told CROSS JOIN ins WHERE ins.t IN (0, 3) GROUP BY conv_id, n, s)
  UNION ALL
  SELECT * FROM (SELECT b.conv_id, b.i - 1 AS i, g.s, min({'cost': b.w.cost + g.k + CASE WHEN j.cut AND g.letter <> 'D' THEN 1 ELSE 0 END, 'audit': g.letters || b.w.audit,
    'said': g.lines || CASE g.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text ELSE chr(10) || g.name || ':' || j.text END || b.w.said}) AS w
  FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.i = j.i JOIN ways g ON g.t = b.s
    AND (g.letter = 'D' OR (NOT j.blank AND NOT j.again AND (g.init IS NULL OR g.init = j.init))) GROUP BY b.conv_id, b.i, g.s))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.w.cost, 0) AS cost, coalesce(b.w.audit, '') AS audit, sha256(coalesce(substr(b.w.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN best b ON b.i = 0 AND b.s = 0 AND c.conv_id IS NOT DISTINCT FROM b.conv_id"""
