"""op12: spelling variants among the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.common import query, table
from sonoframe.llm.spelling import corpus_words, variants

# The table of crc32 for one byte follows from its polynomial.
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
hexed AS (SELECT *, hex(doc_id || ':' || run) AS x FROM low),
hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 1 + len(x) // 2),
      lambda j: (16 * (strpos('0123456789ABCDEF', x[2 * j - 1]) - 1) + strpos('0123456789ABCDEF', x[2 * j]) - 1)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM hexed, crc),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
shorter AS MATERIALIZED (
  SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.less
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.less),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
followed AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM followed JOIN formed USING (word)
WHERE root IN (SELECT word FROM formed WHERE form IS NULL)
"""


@query("op12_spelling_variants", SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(corpus_words(table(spark, sf_dir, "documents"))).select("word", "n", "n_near", "form", "form_n", "root")
