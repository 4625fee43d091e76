"""op3: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.common import query, table
from sonoframe.llm.jaccard import jaccard_components

SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, n, list(s ORDER BY s) AS members FROM shingles JOIN sizes USING (doc_id) GROUP BY doc_id, n),
reps AS (SELECT min(doc_id) AS rep, n, members FROM sets GROUP BY n, members),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM reps) AND b.doc_id IN (SELECT rep FROM reps) GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
  UNION SELECT rep, doc_id FROM sets JOIN reps USING (n, members)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS node, doc_id AS met FROM sizes UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.met)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT node AS doc_id, min(met) AS component_id FROM reached GROUP BY node) c USING (doc_id)
"""


@query("op3_ngram_jaccard_join", SQL)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, similarity=(90, 100))
