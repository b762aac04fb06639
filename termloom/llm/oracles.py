"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from termloom.plans.packed_queries import P4_SQL

_POSTINGS = f"""
WITH p4 AS ({P4_SQL}),
po AS (SELECT t.term, p4.doc_id, max(p4.freq) AS freq FROM p4 JOIN term_freq_rep t USING (rep_id)
       WHERE t.term IS NOT NULL GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc_id) AS n FROM document_vector),
stats AS (SELECT term, count(*) AS records, CAST(sum(freq) AS BIGINT) AS occurrences FROM po GROUP BY 1)
"""
_TERMS = _POSTINGS + """
, terms AS (SELECT t.term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
  CASE WHEN coalesce(records, 0) < 4 THEN 'rare' WHEN records > 0.7 * n THEN 'common' END AS mark
  FROM (SELECT DISTINCT term FROM term_freq_rep WHERE term IS NOT NULL) t LEFT JOIN stats USING (term), n)
"""
_MAPS = "(SELECT DISTINCT doc_id, unnest(map_keys(map)) AS term FROM document_vector WHERE doc_id IS NOT NULL)"
_COSINES = """
WITH RECURSIVE v AS (SELECT doc_id, any_value(map) AS map FROM document_vector WHERE doc_id IS NOT NULL AND cardinality(map) > 0 GROUP BY 1),
e AS (SELECT doc_id, x.key AS term, x.value AS w FROM (SELECT doc_id, unnest(map_entries(map)) AS x FROM v) WHERE x.value IS NOT NULL AND x.value <> 0),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM e),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS cos FROM u x JOIN u y ON x.term = y.term AND x.doc_id <> y.doc_id GROUP BY 1, 2)
"""
_GROUPS = _COSINES + """
, reach AS (SELECT a AS id, a AS other FROM c WHERE cos >= 0.55 UNION SELECT r.id, c.b FROM reach r JOIN c ON c.a = r.other AND c.cos >= 0.55),
groups AS (SELECT id AS doc_id, min(other) AS cluster_key FROM reach GROUP BY 1 HAVING count(*) >= 5)
"""
_WINDOWS = r"""
WITH dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS s
  FROM (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS ws FROM documents) WHERE len(ws) >= 13),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS s
  FROM (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS ws FROM eval_item) WHERE len(ws) >= 13),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s))
"""

ORACLES = {
    "p1_found": _COSINES + """SELECT DISTINCT least(a, b) AS doc_a, greatest(a, b) AS doc_b FROM (
  SELECT a, b, cos, row_number() OVER (PARTITION BY a ORDER BY round(cos, 9) DESC, b) AS r FROM c) WHERE r <= 20 AND cos >= 0.9""",
    "p6_found": _GROUPS + "SELECT cluster_key, doc_id FROM groups",
    "p6_clusters": _GROUPS + """
, m AS (SELECT cluster_key, doc_id, term, w FROM groups JOIN u USING (doc_id)),
centre AS (SELECT cluster_key, term, sum(w) AS c FROM m GROUP BY 1, 2),
fit AS (SELECT cluster_key, doc_id, round(sum(w * c), 9) AS fit FROM m JOIN centre USING (cluster_key, term) GROUP BY 1, 2)
SELECT cluster_key, count(*) AS size, list(doc_id ORDER BY r) FILTER (r <= 3) AS typical
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY fit DESC, doc_id) AS r FROM fit) GROUP BY 1""",
    "p8_found": _WINDOWS + "SELECT doc_id, item_id FROM leaks",
    "p8_items": _WINDOWS + "SELECT item_id, count(*) AS texts FROM leaks GROUP BY 1",
    "p3_terms": _TERMS + "SELECT term, occurrences, records, mark FROM terms",
    "p3_found": _TERMS + "SELECT term, mark FROM terms WHERE mark IS NOT NULL",
    "p5_found": _POSTINGS + f"""
SELECT doc_id, term FROM (
  SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(freq * ln(n / records), 9) DESC, term) AS r
  FROM {_MAPS} m JOIN po USING (doc_id, term) JOIN stats USING (term), n)
WHERE r <= 3""",
    "p5_scores": _POSTINGS + f"""
, len AS (SELECT doc_id, CAST(sum(freq) AS DOUBLE) AS length FROM po GROUP BY 1),
scored AS (SELECT doc_id, term, freq, records AS df, occurrences / n AS rate,
    freq * log2(1 + (SELECT avg(length) FROM len) / length) AS tf
  FROM {_MAPS} m JOIN po USING (doc_id, term) JOIN stats USING (term) JOIN len USING (doc_id), n)
SELECT doc_id, term, freq, df, round((log2(1 + rate) + tf * log2((1 + rate) / rate)) / (tf + 1), 9) AS score FROM scored""",
    "p5_centroids": _POSTINGS + """
, e AS (SELECT DISTINCT cluster_id, term, tf_idf FROM hashmap_data WHERE cluster_id IS NOT NULL AND tf_idf IS NOT NULL),
f AS (SELECT cluster_id, term, tf_idf * records AS freq, occurrences / n AS rate FROM e JOIN stats USING (term), n),
len AS (SELECT cluster_id, sum(freq) AS length FROM f GROUP BY 1),
g AS (SELECT cluster_id, term, rate, freq * log2(1 + (SELECT avg(length) FROM len) / length) AS tf FROM f JOIN len USING (cluster_id))
SELECT cluster_id, term, round((log2(1 + rate) + tf * log2((1 + rate) / rate)) / (tf + 1), 7) AS score FROM g""",
}
