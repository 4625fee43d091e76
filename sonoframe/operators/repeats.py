"""Repeat windows: fingerprints, drift and agreement between copies of one recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.digests import CHUNK, sequence_digests
from sonoframe.operators.scan import SINGLE, Layout, row_index, running
from sonoframe.session import cut

MEDIA = "media_id"


def repeat_windows(segments: DataFrame, period: int, repeats: int) -> DataFrame:
    """Segments wholly inside ``[k*period, (k+1)*period)``, rebased, with ``window_idx``."""
    k = F.floor(F.col("start") / period).cast("bigint")
    # A start exactly on a boundary with zero length cannot fit the earlier window, so one k suffices.
    return (
        segments.withColumn("window_idx", k)
        .where((F.col("window_idx") >= 0) & (F.col("window_idx") < repeats))
        .where(F.col("end") <= (F.col("window_idx") + 1) * period)
        .withColumns(
            {
                "start": F.col("start") - F.col("window_idx") * period,
                "end": F.col("end") - F.col("window_idx") * period,
            }
        )
    )


def window_fingerprints(windowed: DataFrame, layout: Layout, chunk: int = CHUNK) -> DataFrame:
    """Per (recording, window): segment count, digest of the rebased segments, digest of the texts."""
    columns = {
        "segments_sha256": F.to_json(F.struct("end", "speaker", "start", "text")),
        "texts_sha256": F.to_json(F.struct("text")),
    }
    order = ["start", "end", "seg_idx"]
    found = sequence_digests(windowed, [MEDIA, "window_idx"], order, columns, layout, chunk)
    return found.withColumnRenamed("items", "segment_count")


def fingerprints_agree(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.groupBy(MEDIA).agg(
        (F.count_distinct("segments_sha256") == 1).alias("all_segments_equal"),
        (F.count_distinct("texts_sha256") == 1).alias("all_texts_equal"),
    )


def paired_drift(windowed: DataFrame, tolerance, layout: Layout) -> DataFrame:
    """Bound drift of every later window against window 0, where the sequences pair up.

    Pairable means equal counts and equal text and speaker at every position.
    """
    from sonoframe.operators.statistics import order_statistics

    keys = [MEDIA, "window_idx"]
    order = ["start", "end", "seg_idx"]
    indexed = cut(running(windowed, keys, order, layout, idx=row_index()))
    first = indexed.where("window_idx = 0").select(
        MEDIA,
        "idx",
        F.col("start").alias("start_0"),
        F.col("end").alias("end_0"),
        F.col("text").alias("text_0"),
        F.col("speaker").alias("speaker_0"),
    )
    counts = indexed.groupBy(*keys).agg(F.count("*").alias("n"))
    zero = counts.where("window_idx = 0").select(MEDIA, F.col("n").alias("n_0"))
    later = indexed.where("window_idx > 0").join(first, [MEDIA, "idx"], "left")
    same = later.groupBy(*keys).agg(
        F.bool_and(
            F.coalesce(
                F.col("text").eqNullSafe(F.col("text_0"))
                & F.col("speaker").eqNullSafe(F.col("speaker_0"))
                & F.col("start_0").isNotNull(),
                F.lit(False),
            )
        ).alias("_same")
    )
    verdict = (
        counts.where("window_idx > 0")
        .join(zero, MEDIA)
        .join(same, keys)
        .select(*keys, ((F.col("n") == F.col("n_0")) & F.col("_same")).alias("pairable"))
    )
    drifts = later.join(verdict.where("pairable"), keys, "left_semi").select(
        *keys,
        F.explode(
            F.array(F.abs(F.col("start") - F.col("start_0")), F.abs(F.col("end") - F.col("end_0")))
        ).alias("drift"),
    )
    stats = order_statistics(
        drifts,
        keys,
        "drift",
        SINGLE if layout.span is None else layout,
        {"median_drift": "median", "p95_drift": "nearest_0.95", "maximum_drift": "max"},
        count="timestamps",
    )
    return (
        verdict.join(stats, keys, "left")
        .na.fill({"timestamps": 0})
        .withColumn(
            "within_tolerance",
            F.coalesce(F.col("maximum_drift") <= tolerance, F.lit(False)),
        )
    )
