"""DuckDB SQL for the registered queries that SQL can express."""


#: item n-gram containment, by hand: all shingles of all documents that any item has
OP3 = r"""
WITH RECURSIVE
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
il AS (SELECT *, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM il),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM il),
dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k)
       WHERE g IN (SELECT g FROM ig)),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""

OP4 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT *, sum(CASE WHEN p - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY doc_id, run),
k AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prior FROM s),
c AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS heads, max(hi) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(heads, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS class_id FROM g),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
bo AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, bo.b FROM r JOIN bo ON r.reach = bo.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach) AS component_id, min(class_id) AS class_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""

#: For pages that mark their article as <article>, without inner parts that aren't text: all of the given tables.
OP9 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '<br\s*/?>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1|h2|h3|ul|ol|li|div)(?:\s[^>]*)?>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

ORACLES = {"op3_decontamination": OP3, "op4_suffix_dedup": OP4, "op8_ngram_jaccard_join": OP8, "op9_main_text": OP9}
