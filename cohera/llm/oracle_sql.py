"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

OP1 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.e, d.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (
  SELECT doc_id, unnest(range(0, greatest(len(w) - 4, 1))) AS pos, greatest(len(w) - 4, 1) AS size,
         array_to_string(w[pos + 1 : CASE WHEN len(w) >= 5 THEN pos + 5 ELSE len(w) END], ' ') AS x FROM d WHERE len(w) > 0),
bs AS (
  SELECT item_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS pos, greatest(len(w) - 4, 1) AS m,
         array_to_string(w[pos + 1 : CASE WHEN len(w) >= 5 THEN pos + 5 ELSE len(w) END], ' ') AS x FROM b WHERE len(w) > 0),
bc AS (SELECT item_id, n, m, x, count(*) AS c FROM bs GROUP BY ALL),
s AS (
  SELECT DISTINCT doc_id, size, item_id, n, m, unnest(range(greatest(ds.pos - m + 1, 0), ds.pos + 1)) AS start
  FROM ds JOIN bc USING (x)),
v AS (SELECT * FROM s WHERE start = 0 OR start + m <= size),
wc AS (
  SELECT v.doc_id, v.item_id, v.n, v.m, v.start, least(v.m, v.size - v.start) AS mw, ds.x, count(*) AS c
  FROM v JOIN ds ON ds.doc_id = v.doc_id AND ds.pos >= v.start AND ds.pos < v.start + v.m GROUP BY ALL),
lo AS (
  SELECT wc.doc_id, wc.item_id, wc.n, wc.m, wc.start, wc.mw, sum(least(wc.c, bc.c)) AS low
  FROM wc JOIN bc ON bc.item_id = wc.item_id AND bc.x = wc.x GROUP BY ALL),
r AS (SELECT doc_id, item_id, start, n, CAST(low AS DOUBLE) / CAST(mw + m - low AS DOUBLE) AS similarity FROM lo)
SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS n_words, similarity FROM r WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

OP11 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER () AS row FROM v),
p AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, a.label = d.label AS same, d.vec_id, d.row,
         coalesce(list_sum(list_transform(list_zip(a.e, d.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM r a JOIN r d ON a.row <> d.row WHERE a.vec_id % 50 = 0),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, row) <= 5),
n AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, p.vec_id AS negative_id, pos.score AS positive_score, p.score AS negative_score,
         row_number() OVER (PARTITION BY pos.a, pos.row ORDER BY p.score DESC, p.vec_id)::INTEGER AS rank
  FROM pos JOIN p ON p.a = pos.a AND NOT p.same AND 50 * pos.score <= 100 * p.score AND 100 * p.score <= 95 * pos.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

# crc32 by bytes, its table made from the polynomial (a fixed value); near words
# have the same rest without one code point each, or one is the other's rest
OP12 = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
seen AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM seen),
h AS (
  SELECT run, n, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT),
                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM bytes, crc),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS x, b.n AS m FROM less a JOIN less b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.cut = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, min(x) FILTER (WHERE m = top) AS x
  FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN x END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.at WHERE e.form IS NULL
"""

ORACLE = {
    "op1_voronoi_knn": OP1,
    "op3_decontaminate": OP3,
    "op10_ngram_join": OP10,
    "op11_hard_negatives": OP11,
    "op12_spelling": OP12,
}
