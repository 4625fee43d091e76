"""Event-time sessions and windows over streaming segments and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDIA = "media_id"


def session_turns(segments: DataFrame, gap_us: int, delay: str) -> DataFrame:
    """Same-speaker activity bridged across at most ``gap_us``, per label.

    ``segments``: ``(media_id, speaker, ts, length_us)``. The session gap is the segment's own length
    plus the bridge, so long segments hold their session open. An exactly equal gap merges.
    """
    gap = F.concat((F.col("length_us") + gap_us).cast("string"), F.lit(" microseconds"))
    return (
        segments.withWatermark("ts", delay)
        .groupBy(MEDIA, "speaker", F.session_window("ts", gap).alias("session"))
        .agg(F.count("*").alias("segments"), F.sum("length_us").alias("active_us"))
        .select(
            MEDIA,
            "speaker",
            F.unix_micros("session.start").alias("start_us"),
            (F.unix_micros("session.end") - gap_us).alias("end_us"),
            "segments",
            "active_us",
        )
    )


def window_peaks(
    samples: DataFrame, value: Column, by: str, width: str, delay: str, slide: str | None = None
) -> DataFrame:
    """Peak and count per tumbling or sliding event-time window; rows behind the watermark are dropped."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        samples.withWatermark("ts", delay)
        .groupBy(frame.alias("w"), by)
        .agg(F.max(value).alias("peak"), F.count("*").alias("samples"))
        .select(F.unix_micros("w.start").alias("window_us"), by, "peak", "samples")
    )
