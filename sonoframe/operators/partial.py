"""Partial results: coverage, merging, sentence partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.text import stripped_key
from sonoframe.operators.regions import complement, region_ids
from sonoframe.operators.scan import Layout, running, running_sum

MEDIA = "media_id"


def missing_coverage(done: DataFrame, totals: DataFrame, layout: Layout) -> DataFrame:
    """Intervals of the source no finished unit covers."""
    return complement(done.select(MEDIA, "start", "end"), totals, [MEDIA], layout)


def coverage_watermarks(missing: DataFrame, totals: DataFrame) -> DataFrame:
    """Start of the first missing interval; the whole length when nothing is missing."""
    first = missing.groupBy(MEDIA).agg(
        F.min("gap_start").alias("_first"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("_missing")
    )
    return totals.join(first, MEDIA, "left").select(
        MEDIA,
        F.coalesce("_first", "total").alias("watermark"),
        (F.col("total") - F.coalesce("_missing", F.lit(0))).alias("covered"),
    )


def merge_results(parts: list[DataFrame], layout: Layout) -> DataFrame:
    """Segments of several partial runs in timeline order with fresh ids."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return region_ids(merged, "seg-", 4, layout, ("start", "end", "speaker", "seg_idx"))


def words_to_sentences(words: DataFrame, sentences: DataFrame, layout: Layout) -> DataFrame:
    """Give each word to the sentence that consumes it.

    Sentences eat the word stream greedily by stripped text, so a word belongs where its cumulative
    stripped length falls. ``words(media_id, word_idx, text)``, ``sentences(media_id, sentence_idx,
    text)``; empty words go with the sentence that is open at their place.
    """
    sized_words = words.withColumn("_n", F.length(stripped_key(F.col("text"))).cast("bigint"))
    placed = running(
        sized_words, [MEDIA], ["word_idx"], layout, _upto=running_sum(F.col("_n"), inclusive=False)
    )
    sized = sentences.withColumn("_n", F.length(stripped_key(F.col("text"))).cast("bigint")).where("_n > 0")
    ends = running(
        sized, [MEDIA], ["sentence_idx"], layout, _from=running_sum(F.col("_n"), inclusive=False)
    )
    # Both cumulative lengths are one ordered line: the open sentence is the last start at or before
    # the word's own start.
    from sonoframe.operators.scan import as_of

    starts = ends.select(MEDIA, F.col("_from").alias("at"), "sentence_idx")
    return as_of(
        placed.drop("_n"), starts, [MEDIA], "_upto", layout,
        event_at="at", value="sentence_idx", alias="sentence_idx", tie_break=["word_idx"],
    ).select(MEDIA, "word_idx", "text", "sentence_idx")
