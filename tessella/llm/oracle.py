"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM ip),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, i, win.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM dp) d JOIN win ON d.k = win.k AND d.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
itm AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN itm USING (doc_id)
"""

ORACLE_SQL["op6_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200),
h AS (SELECT doc_id, i, md5(b[i:i + 199]) AS m FROM w),
r AS (SELECT doc_id, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
s AS (SELECT doc_id, island, min(i) AS a, max(i) + 199 AS z FROM k GROUP BY doc_id, island),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM s UNION ALL SELECT doc_id, max(z) + 1, NULL FROM s GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(hex(b[f:coalesce(t, n)]), '' ORDER BY f) AS x FROM gap JOIN d USING (doc_id) WHERE f <= coalesce(t, n) GROUP BY doc_id),
tot AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(COALESCE(x, ''))) END AS kept_sha256
FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

ORACLE_SQL["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM s GROUP BY doc_id),
rep AS (SELECT sig, min(doc_id) AS rep FROM sig GROUP BY sig),
rs AS (SELECT s.* FROM s JOIN rep ON s.doc_id = rep.rep),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM rs a JOIN rs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS d, rep AS t FROM rep UNION SELECT r.d, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT d, min(t) AS component_id FROM r GROUP BY d)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(m.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN sig USING (doc_id) LEFT JOIN rep USING (sig) LEFT JOIN m ON m.d = rep.rep
"""

ORACLE_SQL["op7_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
