"""op2: nearest codes of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import query, settle, table
from sonoframe.llm.hamming import sign_codes, top_k

SQL = """
WITH signs AS (
  SELECT vec_id AS id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS s
  FROM embeddings WHERE embedding IS NOT NULL),
codes AS (
  SELECT id, array_to_string(list_transform(s, lambda b: CASE WHEN b THEN '1' ELSE '0' END), '')::BIT AS code FROM signs),
pairs AS (
  SELECT q.id AS query_id, x.id AS neighbour_id, bit_count(xor(q.code, x.code))::BIGINT AS distance
  FROM codes q JOIN codes x ON q.id <> x.id WHERE q.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""


@query("op2_exact_top_k_search", SQL)
def exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = settle(sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "sign-codes")
    return top_k(codes, codes.where(F.col("id") % 20 == 0), k=10)
