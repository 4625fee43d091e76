"""Regions from frame scores, and the other gaps-and-islands forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.rangejoin import bucket_of, with_buckets, BUCKET
from sonoframe.operators.scan import Layout, islands, lag, lead, row_index, running, running_max, settle

MEDIA = "media_id"


@dataclass(frozen=True)
class RegionPolicy:
    """Thresholds and durations in samples; ``milliseconds`` builds one from profile fields."""

    frame: int = 512
    on: float = 0.5
    off: float = 0.35
    min_speech: int = 1600
    min_silence: int = 4800
    pad: int = 1920
    sample_rate: int = 16_000

    @classmethod
    def milliseconds(cls, frame, on, off, speech_ms, silence_ms, pad_ms, sample_rate=16_000):
        def samples(ms):
            return round(sample_rate * ms / 1000)

        return cls(frame, on, off, samples(speech_ms), samples(silence_ms), samples(pad_ms), sample_rate)


def signal_lengths(frames: DataFrame, frame: int) -> DataFrame:
    """Length of each scored signal when only its frames are known."""
    return frames.groupBy(MEDIA).agg(((F.max("frame_idx") + 1) * frame).alias("total_samples"))


def hysteresis_regions(
    frames: DataFrame, lengths: DataFrame, policy: RegionPolicy, layout: Layout
) -> DataFrame:
    """Two-threshold regions ``(media_id, start, end)`` in samples, short ones dropped.

    Every frame looks up the last frame at or above ``on`` (its anchor). The frames below ``off`` that
    share an anchor form one low stretch; a stretch at least ``min_silence`` long closes the region at
    its first frame, and the next anchor opens the following one. Frames between the thresholds never
    matter and are dropped before the scan.
    """
    high, low = F.col("prob") >= policy.on, F.col("prob") < policy.off
    marked = frames.where(high | low).select(
        MEDIA,
        "frame_idx",
        F.when(high, F.col("frame_idx")).alias("high_idx"),
        F.when(~high & low, F.col("frame_idx")).alias("low_idx"),
    )
    seen = running(
        marked,
        [MEDIA],
        ["frame_idx"],
        layout,
        anchor=running_max(F.col("high_idx"), inclusive=False),
        previous_low=running_max(F.col("low_idx"), inclusive=False),
    )
    opens = F.col("high_idx").isNotNull() & (
        F.col("anchor").isNull() | (F.col("previous_low") > F.col("anchor"))
    )
    stretches = (
        seen.where(opens | (F.col("low_idx").isNotNull() & F.col("anchor").isNotNull()))
        .groupBy(MEDIA, F.coalesce("anchor", F.lit(-1)).alias("anchor"))
        .agg(
            F.min("low_idx").alias("first_low"),
            F.max("low_idx").alias("last_low"),
            F.min("high_idx").alias("next_high"),
        )
    )
    long_enough = (F.col("last_low") - F.col("first_low")) * policy.frame >= policy.min_silence
    breaks = settle(stretches.where((F.col("anchor") < 0) | long_enough), layout)
    paired = running(breaks, [MEDIA], ["anchor"], layout, close_idx=lead(F.col("first_low")))
    return (
        paired.where(F.col("next_high").isNotNull())
        .join(lengths, MEDIA)
        .select(
            MEDIA,
            (F.col("next_high") * policy.frame).cast("bigint").alias("start"),
            F.coalesce(F.col("close_idx") * policy.frame, F.col("total_samples"))
            .cast("bigint")
            .alias("end"),
            "total_samples",
        )
        .where(F.col("end") - F.col("start") >= policy.min_speech)
    )


def bridge_gaps(regions: DataFrame, gap: int, layout: Layout) -> DataFrame:
    """Join neighbours whose gap is at most ``gap``; inputs are disjoint and ordered by start."""
    seen = running(regions, [MEDIA], ["start"], layout, previous_end=lag(F.col("end")))
    new = F.col("previous_end").isNull() | (F.col("start") - F.col("previous_end") > gap)
    return (
        islands(seen, [MEDIA], ["start"], layout, new)
        .groupBy(MEDIA, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.first("total_samples").alias("total_samples"),
        )
        .drop("island")
    )


def pad_regions(regions: DataFrame, pad: int, layout: Layout) -> DataFrame:
    """Pad both sides inside the signal; padded neighbours that collide meet at their midpoint."""
    seen = running(
        regions,
        [MEDIA],
        ["start"],
        layout,
        previous_end=lag(F.col("end")),
        next_start=lead(F.col("start")),
    )
    left = F.greatest(F.lit(0), F.col("start") - pad)
    right = F.least(F.col("total_samples"), F.col("end") + pad)
    previous_right = F.least(F.col("total_samples"), F.col("previous_end") + pad)
    next_left = F.greatest(F.lit(0), F.col("next_start") - pad)

    def middle(a: Column, b: Column) -> Column:
        return F.floor((a + b) / 2).cast("bigint")

    return seen.select(
        MEDIA,
        F.when(
            F.col("previous_end").isNotNull() & (left < previous_right),
            middle(previous_right, left),
        )
        .otherwise(left)
        .cast("bigint")
        .alias("start"),
        F.when(
            F.col("next_start").isNotNull() & (next_left < right), middle(right, next_left)
        )
        .otherwise(right)
        .cast("bigint")
        .alias("end"),
        "total_samples",
    )


def speech_regions(
    frames: DataFrame,
    policy: RegionPolicy,
    layout: Layout,
    lengths: DataFrame | None = None,
    pad_first: bool = False,
    pad_first_gap: int = 4800,
) -> DataFrame:
    """Hysteresis, then pad and split. ``pad_first`` bridges padded regions afterwards instead.

    Raw gaps after hysteresis are always longer than ``min_silence`` (a closing stretch already is, and
    dropping a short region only widens its gap), so the raw-gap merge cannot fire here and no scan is
    spent on it; :func:`bridge_gaps` serves inputs of other origins.
    """
    lengths = signal_lengths(frames, policy.frame) if lengths is None else lengths
    raw = settle(hysteresis_regions(frames, lengths, policy, layout), layout)
    padded = pad_regions(raw, policy.pad, layout)
    return bridge_gaps(padded, pad_first_gap, layout) if pad_first else padded


REGION_CHUNK = 1024


def region_statistics(regions: DataFrame, frames: DataFrame, policy: RegionPolicy) -> DataFrame:
    """Mean and peak score over the frames each region touches.

    A long region is cut into frame chunks, so its frames are averaged by many tasks before the final
    combine.
    """
    spans = regions.select(
        MEDIA,
        "start",
        "end",
        bucket_of(F.col("start"), policy.frame).alias("first_frame"),
        F.ceil(F.col("end") / F.lit(policy.frame)).cast("bigint").alias("stop_frame"),
    )
    pieces = with_buckets(spans, "first_frame", "stop_frame", REGION_CHUNK)
    scored = frames.select(MEDIA, "frame_idx", "prob").withColumn(
        BUCKET, bucket_of(F.col("frame_idx"), REGION_CHUNK)
    )
    inside = (F.col("frame_idx") >= F.col("first_frame")) & (F.col("frame_idx") < F.col("stop_frame"))
    return (
        pieces.join(scored, [MEDIA, BUCKET], "left")
        .where(inside | F.col("frame_idx").isNull())
        .groupBy(MEDIA, "start", "end")
        .agg(
            F.coalesce(F.avg("prob"), F.lit(0.0)).alias("mean_probability"),
            F.coalesce(F.max("prob"), F.lit(0.0)).alias("peak_probability"),
        )
    )


def region_ids(regions: DataFrame, prefix: str, digits: int, layout: Layout, order=("start",)) -> DataFrame:
    """Ordinal ids by sorted position: ``prefix`` + zero-padded number from 1."""
    numbered = running(regions, [MEDIA], list(order), layout, _n=row_index())
    return numbered.withColumn(
        "region_id", F.format_string(f"{prefix}%0{digits}d", F.col("_n") + 1)
    ).drop("_n")


def activity_clusters(active: DataFrame, max_gap_frames: int, layout: Layout) -> DataFrame:
    """Runs of active frames, bridging at most ``max_gap_frames`` inactive ones."""
    seen = running(active, [MEDIA], ["frame_idx"], layout, previous=lag(F.col("frame_idx")))
    new = F.col("previous").isNull() | (F.col("frame_idx") - F.col("previous") - 1 > max_gap_frames)
    return (
        islands(seen, [MEDIA], ["frame_idx"], layout, new)
        .groupBy(MEDIA, "island")
        .agg(F.min("frame_idx").alias("first_frame"), (F.max("frame_idx") + 1).alias("stop_frame"))
        .drop("island")
    )


def merge_intervals(intervals: DataFrame, keys, layout: Layout, start="start", end="end") -> DataFrame:
    """Union of overlapping or touching intervals per key.

    Copies and equal starts collapse first, so the scan sees each start once whatever the duplication.
    """
    distinct = settle(intervals.groupBy(*keys, start).agg(F.max(end).alias(end)), layout)
    seen = running(distinct, keys, [start], layout, _reach=running_max(F.col(end), inclusive=False))
    new = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    return (
        islands(seen, keys, [start], layout, new)
        .groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("island")
    )


def complement(
    intervals: DataFrame, totals: DataFrame, keys, layout: Layout, start="start", end="end"
) -> DataFrame:
    """Gaps of ``[0, total)`` left by the intervals of each key."""
    merged = merge_intervals(intervals, keys, layout, start, end)
    edge = totals.select(*keys, F.lit(0).cast("bigint").alias(start), F.lit(0).cast("bigint").alias(end))
    withzero = settle(
        merged.unionByName(edge).groupBy(*keys, start).agg(F.max(end).alias(end)), layout
    )
    following = running(withzero, keys, [start], layout, _next=lead(F.col(start)))
    return (
        following.join(totals, list(keys))
        .select(
            *keys,
            F.col(end).alias("gap_start"),
            F.least(F.coalesce("_next", "total"), F.col("total")).alias("gap_end"),
        )
        .where(F.col("gap_end") > F.col("gap_start"))
    )


def label_segments(labelled: DataFrame, layout: Layout) -> DataFrame:
    """Maximal runs of consecutive frames per label from ``(media_id, frame_idx, label)``."""
    keys = [MEDIA, "label"]
    seen = running(labelled, keys, ["frame_idx"], layout, previous=lag(F.col("frame_idx")))
    new = F.col("previous").isNull() | (F.col("frame_idx") - F.col("previous") > 1)
    return (
        islands(seen, keys, ["frame_idx"], layout, new)
        .groupBy(*keys, "island")
        .agg(F.min("frame_idx").alias("first_frame"), (F.max("frame_idx") + 1).alias("stop_frame"))
        .drop("island")
    )
