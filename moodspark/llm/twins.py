"""DuckDB statements of operators whose definition is short in SQL, for whole
tables of a test's size: all windows, and all pairs that share a shingle."""

SUBSTRING_DEDUP = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, b[i:i + 49] AS w FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM b)),
least_ AS (SELECT w, min(doc_id) AS d FROM win GROUP BY w),
gone AS (SELECT doc_id, i FROM win JOIN least_ USING (w) WHERE d < doc_id),
edge AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS head FROM gone),
run AS (SELECT doc_id, i, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM run GROUP BY doc_id, run),
keep AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z, z - a + 1 AS cut FROM span),
tail AS (SELECT doc_id, max(z) + 1 AS a FROM span GROUP BY doc_id),
parts AS (SELECT k.doc_id, k.a, hex(b.b[k.a:k.z]) AS h FROM keep k JOIN b USING (doc_id) WHERE k.z >= k.a
          UNION ALL SELECT t.doc_id, t.a, hex(b.b[t.a:octet_length(b.b)]) FROM tail t JOIN b USING (doc_id) WHERE t.a <= octet_length(b.b)),
kept AS (SELECT doc_id, string_agg(h, '' ORDER BY a) AS h FROM parts GROUP BY doc_id),
total AS (SELECT doc_id, sum(cut) AS n_removed, count(*) AS n_spans FROM keep GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.b) AS n_bytes, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
  sha256(CASE WHEN t.doc_id IS NULL THEN b.b ELSE unhex(coalesce(kept.h, '')) END) AS kept_sha256
FROM b LEFT JOIN total t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS component FROM documents UNION SELECT e.b, r.component FROM reach r JOIN edges e ON r.doc_id = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.component) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
