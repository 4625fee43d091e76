"""op11: fill-in-the-middle outputs of all documents, from frames written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.common import query, scratch, settle, table
from sonoframe.llm.frames import digests, fill_in_middle, write_frames

SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         list_transform(range(4), lambda k: list_reduce(
           list_transform(range(1, 9), lambda j: (strpos('0123456789abcdef', sha256('1:' || doc_id)[8 * k + j]) - 1)::BIGINT),
           lambda a, b: 16 * a + b)) AS h
  FROM documents),
cut AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op11_fill_in_middle", SQL)
def middle_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        store = settle(write_frames(table(spark, sf_dir, "documents")), "text-frames")
        return keep(settle(digests(fill_in_middle(store)), "middle-digests"))
