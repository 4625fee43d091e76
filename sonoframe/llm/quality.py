"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets word and line counts. Two base rules are fixed: too few words, or too many repeated words. The
other limits come from the corpus: per (language, source) one quantile sketch of each ratio, sketches of a language
merged from those of its sources. A fence is

    median + REACH * max(median - lower quartile, least spread of the ratio)

The lower half of a distribution sets the width, so up to half of it may be junk without widening it. The limit of a
group with fewer than OWN_DOCS documents is the fence of its language. A larger one may have a limit of its own where
its fence is wider, but no further from its language's median than FAR times its language's fence: a source that is
junk for the most part has a wide fence and is held by its language's.

Defined results: null or empty text has no words and fails; a null language or source counts as the empty string;
repeated rows are judged each; an empty table gives no rows; other columns are kept by `with_features` and `judge`,
in which columns named like an output, or starting with `_q_`, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import settle, small

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"
UPPER = r"[^A-Z]+"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
REACH = 6.0
#: Documents that a group needs for a fence of its own, and how far that may lie beyond its language's.
OWN_DOCS, FAR = 50, 2.0
#: Least spread of each ratio: below it a group counts as uniform.
LEAST_SPREAD = {
    "symbol_ratio": 0.01,
    "dup_line_ratio": 0.07,
    "repeat_ratio": 0.05,
    "mean_word_chars": 0.25,
    "upper_ratio": 0.02,
}
#: Sketch size: exact up to so many values, a rank error of about 0.1 % beyond.
SKETCH_K = 4096
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeated_words(found: Column) -> Column:
    """Words covered by three-word windows, given (hash, position) of all windows sorted."""
    twins = F.filter(
        found,
        lambda w, j: (w["h"] == F.get(found, j - 1)["h"]) | (w["h"] == F.get(found, j + 1)["h"]),
    )
    starts = F.sort_array(F.transform(twins, lambda w: w["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"],
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the columns of COUNTS, the ratios of LEAST_SPREAD and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<bigint>")
    cut = (
        docs.drop(*(c for c in docs.columns if c.startswith("_q_")))
        .withColumn("_q_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
        .withColumn("_q_lines", F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)))
        .withColumn(
            "_q_windows",
            F.when(F.size("_q_words") < 3, none).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size("_q_words") - 3),
                    lambda i: F.xxhash64(F.get("_q_words", i), F.get("_q_words", i + 1), F.get("_q_words", i + 2)),
                )
            ),
        )
        .withColumn(
            "_q_sorted",
            F.when(
                F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
                F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        )
    )
    counted = cut.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, SYMBOL, "")).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("_q_sorted")).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_upper": F.length(F.regexp_replace(body, UPPER, "")).cast("long"),
        }
    ).drop("_q_words", "_q_lines", "_q_windows", "_q_sorted")
    return counted.withColumns(
        {
            "symbol_ratio": F.try_divide("n_symbols", "word_chars"),
            "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
            "repeat_ratio": F.try_divide("n_repeat_words", "n_words"),
            "mean_word_chars": F.try_divide("word_chars", "n_words"),
            "upper_ratio": F.try_divide("n_upper", "word_chars"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
        }
    )


def _fence(sketch: Column, ratio: str, reach: float = REACH) -> Column:
    middle, lower = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.5, 0.25))
    return middle + reach * F.greatest(middle - lower, F.lit(LEAST_SPREAD[ratio]))


def _limit(ratio: str) -> Column:
    own, merged = F.col(f"{ratio}_sketch"), F.col(f"{ratio}_merged")
    wider = F.least(F.greatest(_fence(own, ratio), _fence(merged, ratio)), _fence(merged, ratio, REACH * FAR))
    return F.when(F.col("_q_docs") >= OWN_DOCS, wider).otherwise(_fence(merged, ratio))


def thresholds(features: DataFrame) -> DataFrame:
    """Per (_q_lang, _q_source): _q_docs and `_q_<ratio>`, from documents that pass the base rules, written once.

    Beyond SKETCH_K values a sketch draws at random, so limits that are computed again may differ.
    """
    keyed = features.where(~F.col("base_failed")).select(
        F.coalesce("lang", F.lit("")).alias("_q_lang"), F.coalesce("source", F.lit("")).alias("_q_source"), *LEAST_SPREAD
    )
    # Partial sketches are built before the shuffle, so a hot source moves one sketch per task.
    by_group = keyed.groupBy("_q_lang", "_q_source").agg(
        F.count(F.lit(1)).alias("_q_docs"),
        *(F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(f"{r}_sketch") for r in LEAST_SPREAD),
    )
    by_language = by_group.groupBy("_q_lang").agg(
        *(F.kll_merge_agg_double(f"{r}_sketch", F.lit(SKETCH_K)).alias(f"{r}_merged") for r in LEAST_SPREAD)
    )
    limits = by_group.join(by_language, "_q_lang").select(
        "_q_lang",
        "_q_source",
        "_q_docs",
        *(_limit(r).alias(f"_q_{r}") for r in LEAST_SPREAD),
    )
    return settle(limits, "quality-limits")


def judge(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept: base rules passed and no ratio above its limit."""
    keyed = features.withColumns(
        {"_q_lang": F.coalesce("lang", F.lit("")), "_q_source": F.coalesce("source", F.lit(""))}
    )
    within = F.lit(True)
    for ratio in LEAST_SPREAD:
        within &= F.coalesce(F.col(ratio) <= F.col(f"_q_{ratio}"), F.lit(False))
    joined = keyed.join(small(limits), ["_q_lang", "_q_source"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop(
        "_q_lang", "_q_source", "_q_docs", *(f"_q_{r}" for r in LEAST_SPREAD)
    )
