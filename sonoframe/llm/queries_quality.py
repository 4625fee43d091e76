"""op5: quality verdicts for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.common import query, scratch, settle, table
from sonoframe.llm.quality import FAR, LEAST_SPREAD, OWN_DOCS, REACH, judge, thresholds, with_features

_RATIOS = {
    "symbol_ratio": "n_symbols / nullif(word_chars, 0)",
    "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_ratio": "n_repeat_words / nullif(n_words, 0)",
    "mean_word_chars": "word_chars / nullif(n_words, 0)",
    "upper_ratio": "n_upper / nullif(word_chars, 0)",
}


def _fence(values: str, ratio: str, reach: float = REACH) -> str:
    rank = lambda q: f"{values}[greatest(1, ceil({q} * len({values})))::INT]"
    return f"({rank(0.5)} + {reach} * greatest({rank(0.5)} - {rank(0.25)}, {LEAST_SPREAD[ratio]}))"


def _limit(ratio: str) -> str:
    own, merged = f"{ratio}_own", f"{ratio}_all"
    wider = f"least(greatest({_fence(own, ratio)}, {_fence(merged, ratio)}), {_fence(merged, ratio, REACH * FAR)})"
    return f"CASE WHEN docs >= {OWN_DOCS} THEN {wider} ELSE {_fence(merged, ratio)} END"


# Sketches of this size are exact on tables of up to a few thousand rows, where this statement is compared.
SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, coalesce(r.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN repeated r USING (doc_id)),
ratios AS (
  SELECT *, {", ".join(f"{e} AS {r}" for r, e in _RATIOS.items())},
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts),
by_group AS (
  SELECT lang, source, count(*) AS docs, {", ".join(f"list_sort(list({r})) AS {r}_own" for r in _RATIOS)}
  FROM ratios WHERE NOT base_failed GROUP BY lang, source),
by_language AS (
  SELECT lang, {", ".join(f"list_sort(list({r})) AS {r}_all" for r in _RATIOS)}
  FROM ratios WHERE NOT base_failed GROUP BY lang),
fences AS (
  SELECT lang, source, {", ".join(f"{_limit(r)} AS {r}_limit" for r in _RATIOS)}
  FROM by_group JOIN by_language USING (lang))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({r} <= {r}_limit, false)" for r in _RATIOS)} AS kept
FROM ratios LEFT JOIN fences USING (lang, source)
"""


@query("op5_quality_rules", SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    with scratch(spark) as keep:
        features = settle(with_features(docs).drop("text"), "quality")
        return keep(settle(judge(features, thresholds(features)).select(columns), "quality-verdicts"))
