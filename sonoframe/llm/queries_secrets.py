"""op1: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import query, table
from sonoframe.llm.secrets import BASE, RULES, find_secrets


def _sql_kind(rule) -> str:
    pattern = rule.linear.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {RULES.index(rule)} AS rank, i,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0) AS start,
         length(found[i]) AS size
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps,
                     regexp_extract_all(text, '{pattern}', {rule.group}) AS inner_text FROM texts))
  WHERE length(inner_text[i]) >= {rule.least}"""


_LIST = "string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank)"
_BASE = "kind IN ('assign', 'access', 'hex')"

SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_sql_kind(r) for r in RULES)}),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex, {_LIST} FILTER (WHERE {_BASE}) AS base, {_LIST} AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r.kind) for r in RULES)), kind)


def _joined(spans: Column) -> Column:
    ordered = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_secret_scans", SQL)
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    names = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in names),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
