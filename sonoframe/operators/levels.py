"""Measurements of chunked signals.

``samples`` rows are ``(media_id, chunk_id, start_sample, ch0 ARRAY, ch1 ARRAY or NULL)`` with
``chunk_len`` samples in every chunk but the last. Work is keyed by chunk until it is reduced to frames
or sums, so a long recording is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import levels as L
from sonoframe.operators.rangejoin import BUCKET, with_buckets
from sonoframe.operators.regions import label_segments, merge_intervals, region_ids
from sonoframe.operators.scan import Layout, as_of, islands, lag, running, settle
from sonoframe.operators.statistics import order_statistics
from sonoframe.session import cut

MEDIA = "media_id"


def samples_long(samples: DataFrame, *extra: str) -> DataFrame:
    """One row per sample ``(media_id, i, l, r, mono)``; only ever feeds an aggregation."""
    at = samples.select(
        MEDIA, *extra, "start_sample", "ch0", "ch1", F.posexplode("ch0").alias("_k", "_l")
    )
    left = F.col("_l").cast("double")
    right = F.get(F.col("ch1"), F.col("_k")).cast("double")
    return at.select(
        MEDIA,
        *extra,
        (F.col("start_sample") + F.col("_k")).alias("i"),
        left.alias("l"),
        right.alias("r"),
        F.when(F.col("ch1").isNull(), left).otherwise((left + right) / 2.0).alias("mono"),
    )


def signal_sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy(MEDIA).agg(
        F.max(F.col("start_sample") + F.size("ch0")).cast("bigint").alias("total_samples")
    )


def frame_levels(samples: DataFrame, frame: int) -> DataFrame:
    """Level of the mono mix per fixed frame."""
    return (
        samples_long(samples)
        .groupBy(MEDIA, F.floor(F.col("i") / frame).cast("bigint").alias("frame_idx"))
        .agg(F.sum(F.col("mono") * F.col("mono")).alias("square_sum"))
        .select(MEDIA, "frame_idx", L.frame_db(F.col("square_sum"), frame).alias("level_dbfs"))
    )


def pcm_channel_levels(samples: DataFrame, frame: int) -> DataFrame:
    """Per-channel level of 16-bit frames and their difference, with the PCM floor."""
    left, right = F.round(F.col("l") * L.PCM_SCALE), F.round(F.col("r") * L.PCM_SCALE)
    framed = (
        samples_long(samples)
        .groupBy(MEDIA, F.floor(F.col("i") / frame).cast("bigint").alias("frame_idx"))
        .agg(F.sum(left * left).alias("ll"), F.sum(right * right).alias("rr"))
    )
    levelled = framed.select(
        MEDIA,
        "frame_idx",
        L.pcm_db(F.col("ll"), F.lit(frame)).alias("left_dbfs"),
        L.pcm_db(F.col("rr"), F.lit(frame)).alias("right_dbfs"),
    )
    return levelled.withColumn("left_minus_right_db", F.col("left_dbfs") - F.col("right_dbfs"))


CONSTANT = 1e-12


def whole_measures(samples: DataFrame) -> DataFrame:
    """Levels, peak, channel relation and offset of each whole recording, from one aggregation."""
    both = F.col("l") * F.col("l") + F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    sums = (
        samples_long(samples)
        .groupBy(MEDIA)
        .agg(
            F.count("*").alias("n"),
            F.count("r").alias("n_right"),
            F.sum(both).alias("square_sum"),
            F.sum(F.col("l") * F.col("l")).alias("ll"),
            F.sum(F.col("r") * F.col("r")).alias("rr"),
            F.sum(F.col("l") * F.col("r")).alias("lr"),
            F.max(F.greatest(F.abs("l"), F.coalesce(F.abs("r"), F.lit(0.0)))).alias("peak"),
            F.stddev_pop("l").alias("sl"),
            F.stddev_pop("r").alias("sr"),
            F.corr("l", "r").alias("pearson"),
            F.avg("mono").alias("dc_offset"),
        )
    )
    left, right = L.rms_db(F.col("ll"), F.col("n")), L.rms_db(F.col("rr"), F.col("n_right"))
    stereo = F.col("n_right") > 0
    constant = (F.col("sl") < CONSTANT) | (F.col("sr") < CONSTANT)
    return sums.select(
        MEDIA,
        F.col("n").alias("total_samples"),
        F.when(stereo, 2).otherwise(1).alias("channels"),
        L.rms_db(F.col("square_sum"), F.col("n") + F.col("n_right")).alias("rms_dbfs"),
        L.peak_db(F.col("peak")).alias("peak_dbfs"),
        left.alias("left_rms_dbfs"),
        F.when(stereo, right).otherwise(left).alias("right_rms_dbfs"),
        F.when(stereo, left - right).otherwise(0.0).alias("channel_difference_db"),
        F.when(stereo & ~constant, F.col("pearson")).alias("channel_correlation"),
        (F.col("lr") / F.nullif(F.sqrt(F.col("ll") * F.col("rr")), F.lit(0.0))).alias(
            "uncentered_correlation"
        ),
        "dc_offset",
    )


def noise_floor(frames: DataFrame, layout: Layout) -> DataFrame:
    """20th percentile (linear) of the finite frame levels; -120 where there are none."""
    finite = frames.where(~F.isnan("level_dbfs") & (F.abs("level_dbfs") != F.lit(float("inf"))))
    return order_statistics(
        finite, [MEDIA], "level_dbfs", layout, {"noise_floor_dbfs": "linear_0.2"}, "frames"
    ).select(MEDIA, "noise_floor_dbfs")


def interval_slices(samples: DataFrame, intervals: DataFrame, chunk_len: int, *extra: str) -> DataFrame:
    """The part of every chunk inside each integer interval ``[start, end)``: an equi-join on chunks."""
    pieces = with_buckets(intervals, "start", "end", chunk_len).withColumnRenamed(BUCKET, "chunk_id")
    low = F.greatest(F.col("start") - F.col("start_sample"), F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("start_sample"), F.size("ch0")).cast("int")
    joined = samples.join(pieces, [MEDIA, "chunk_id"]).withColumns({"_low": low, "_high": high})
    kept = joined.where(F.col("_high") > F.col("_low"))
    part = F.col("_high") - F.col("_low")
    return kept.select(
        MEDIA,
        "chunk_id",
        *extra,
        "start",
        "end",
        (F.col("start_sample") + F.col("_low")).alias("start_sample"),
        F.slice("ch0", F.col("_low") + 1, part).alias("ch0"),
        F.slice("ch1", F.col("_low") + 1, part).alias("ch1"),
    )


def interval_levels(samples: DataFrame, intervals: DataFrame, chunk_len: int, *keys: str) -> DataFrame:
    """RMS level over all channels per key; a chunk is summed before anything is shuffled by key."""
    long = samples_long(interval_slices(samples, intervals, chunk_len, *keys), *keys)
    both = F.col("l") * F.col("l") + F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    sums = long.groupBy(MEDIA, *keys).agg(
        F.sum(both).alias("_s"), (F.count("l") + F.count("r")).alias("_n")
    )
    return sums.select(MEDIA, *keys, L.rms_db(F.col("_s"), F.col("_n")).alias("level_dbfs"))


def speech_levels(samples: DataFrame, speech: DataFrame, chunk_len: int, layout: Layout) -> DataFrame:
    """Level of the union of the speech regions; recordings without speech get the empty floor."""
    union = merge_intervals(speech.select(MEDIA, "start", "end"), [MEDIA], layout)
    measured = interval_levels(samples, union, chunk_len)
    everyone = samples.select(MEDIA).distinct()
    return everyone.join(measured, MEDIA, "left").select(
        MEDIA, F.coalesce("level_dbfs", F.lit(L.EMPTY_DB)).alias("speech_rms_dbfs")
    )


def machine_regions(
    samples: DataFrame,
    speech: DataFrame,
    rate: int,
    chunk_len: int,
    layout: Layout,
) -> DataFrame:
    """Salient non-speech programme: frames outside speech well above floor and speech, bridged,
    padded, re-measured, numbered after the filters."""
    frame = max(1, round(rate * 0.1))
    pad, shortest = round(0.04 * rate), round(0.12 * rate)
    frames = cut(frame_levels(samples, frame))
    limits = cut(
        noise_floor(frames, layout)
        .join(speech_levels(samples, speech, chunk_len, layout), MEDIA)
        .withColumn(
            "threshold_dbfs",
            F.greatest(
                F.col("noise_floor_dbfs") + 15.0, F.col("speech_rms_dbfs") + 3.0, F.lit(-55.0)
            ),
        )
    )
    union = settle(merge_intervals(speech.select(MEDIA, "start", "end"), [MEDIA], layout), layout)
    packed = union.withColumn("_region", F.struct("start", "end")).select(MEDIA, "start", "_region")
    loud = (
        frames.join(limits, MEDIA)
        .where(F.col("level_dbfs") >= F.col("threshold_dbfs"))
        .select(MEDIA, "frame_idx", (F.col("frame_idx") * frame + frame // 2).alias("midpoint"))
    )
    placed = as_of(
        loud, packed, [MEDIA], "midpoint", layout,
        event_at="start", value="_region", alias="_held", tie_break=["frame_idx"],
    )
    outside = placed.where(F.coalesce(F.col("midpoint") >= F.col("_held.end"), F.lit(True)))
    seen = running(outside.select(MEDIA, "frame_idx"), [MEDIA], ["frame_idx"], layout, _p=lag(F.col("frame_idx")))
    new = F.col("_p").isNull() | (F.col("frame_idx") - F.col("_p") > 3)
    groups = (
        islands(seen, [MEDIA], ["frame_idx"], layout, new)
        .groupBy(MEDIA, "island")
        .agg(F.min("frame_idx").alias("first"), (F.max("frame_idx") + 1).alias("stop"))
    )
    padded = (
        cut(groups)
        .join(signal_sizes(samples), MEDIA)
        .select(
            MEDIA,
            F.greatest(F.lit(0), F.col("first") * frame - pad).alias("start"),
            F.least(F.col("total_samples"), F.col("stop") * frame + pad).alias("end"),
            F.col("island"),
        )
        .where(F.col("end") - F.col("start") >= shortest)
    )
    measured = (
        interval_levels(samples, padded, chunk_len, "island")
        .join(padded, [MEDIA, "island"])
        .join(limits, MEDIA)
        .where(F.col("level_dbfs") >= F.col("noise_floor_dbfs") + 8.0)
    )
    measured = settle(measured, layout)
    # A region overlaps speech when the last merged region starting before its end reaches past its start.
    flagged = as_of(
        measured, packed, [MEDIA], "end", layout,
        event_at="start", value="_region", alias="_near", tie_break=["island"], include_equal=False,
    ).withColumn("overlaps_speech", F.coalesce(F.col("_near.end") > F.col("start"), F.lit(False)))
    return region_ids(settle(flagged, layout), "machine_audio_", 3, layout).select(
        MEDIA,
        "region_id",
        "start",
        "end",
        "level_dbfs",
        (F.col("level_dbfs") - F.col("speech_rms_dbfs")).alias("difference_db"),
        "overlaps_speech",
    )


def treatment_intervals(
    samples: DataFrame,
    speech: DataFrame,
    machine: DataFrame,
    measures: DataFrame,
    profile: dict,
    rate: int,
    layout: Layout,
) -> DataFrame:
    """Grow speech regions to the silence-anchored activity around them, in seconds.

    ``speech``/``machine``: integer sample bounds. ``measures``: ``noise_floor_dbfs`` and
    ``speech_rms_dbfs`` per recording.
    """
    from sonoframe.operators.intervals import cluster_bounds, neighbour_bounds
    from sonoframe.operators.regions import activity_clusters

    frame = max(1, round(rate * 0.02))
    bridge = max(0, round(profile["voice_boundary_bridge_silence_ms"] / 20.0))
    fade = profile["region_fade_ms"] / 1000.0
    guard = profile["voice_boundary_guard_ms"] / 1000.0
    search = profile["voice_boundary_search_ms"] / 1000.0
    threshold = F.greatest(
        F.col("noise_floor_dbfs") + profile["voice_boundary_noise_margin_db"],
        F.col("speech_rms_dbfs") - profile["voice_boundary_speech_margin_db"],
    )
    active = (
        frame_levels(samples, frame)
        .join(measures, MEDIA)
        .where(F.col("level_dbfs") >= threshold)
        .select(MEDIA, "frame_idx")
    )
    sizes = signal_sizes(samples)
    clusters = (
        activity_clusters(active, bridge, layout)
        .join(sizes, MEDIA)
        .select(
            MEDIA,
            (F.col("first_frame") * frame).alias("start"),
            F.least(F.col("total_samples"), F.col("stop_frame") * frame).alias("end"),
        )
    )
    found = settle(cluster_bounds(speech, settle(clusters, layout), layout, "region_id"), layout)
    near = neighbour_bounds(found, machine, layout, "region_id").join(sizes, MEDIA)

    def sec(name: str) -> Column:
        return F.col(name) / float(rate)

    hit = F.col("first_start").isNotNull()
    grown = near.withColumns(
        {
            "acoustic_start": F.when(hit, F.greatest(sec("start") - search, sec("first_start"))).otherwise(sec("start")),
            "acoustic_end": F.when(hit, F.least(sec("end") + search, sec("last_end"))).otherwise(sec("end")),
        }
    )
    start = F.when(hit, F.least(sec("start"), F.col("acoustic_start") - guard)).otherwise(sec("start"))
    end = F.when(hit, F.greatest(sec("end"), F.col("acoustic_end") + guard)).otherwise(sec("end"))
    # greatest/least skip nulls: a recording without a neighbour on that side is not clamped.
    start = F.greatest(start, sec("preceding_end") + fade)
    end = F.least(end, sec("following_start") - fade)
    return grown.select(
        MEDIA,
        "region_id",
        sec("start").alias("region_start"),
        sec("end").alias("region_end"),
        "acoustic_start",
        "acoustic_end",
        F.greatest(F.lit(0.0), F.least(start, sec("start"))).alias("treatment_start"),
        F.least(sec("total_samples"), F.greatest(end, sec("end"))).alias("treatment_end"),
    )


def channel_labels(frames: DataFrame, gate: float, ladder: list[float]) -> DataFrame:
    """Dominant-channel labels per frame for every threshold of the ladder."""
    step = F.explode(F.array(*[F.lit(float(d)) for d in ladder])).alias("dominance_db")
    both = F.array(F.lit("channel_left"), F.lit("channel_right"))
    difference = F.col("left_minus_right_db")
    labels = (
        F.when(F.greatest("left_dbfs", "right_dbfs") < gate, F.array().cast("array<string>"))
        .when(difference > F.col("dominance_db"), F.slice(both, 1, 1))
        .when(difference < -F.col("dominance_db"), F.slice(both, 2, 1))
        .otherwise(both)
    )
    return frames.select("*", step).withColumn("labels", labels)


def channel_segments(labelled: DataFrame, frame: int, sizes: DataFrame, layout: Layout) -> DataFrame:
    """Maximal same-label runs of one ladder step, in samples, clipped to the signal."""
    long = labelled.select(MEDIA, "frame_idx", F.explode("labels").alias("label"))
    return (
        label_segments(long, layout)
        .join(sizes, MEDIA)
        .select(
            MEDIA,
            F.col("label").alias("speaker"),
            (F.col("first_frame") * frame).alias("start"),
            F.least(F.col("total_samples"), F.col("stop_frame") * frame).alias("end"),
        )
    )


def exclusive_dominance(frames: DataFrame, layout: Layout) -> DataFrame:
    """Channel difference of frames with exactly one active speaker: ``(media_id, speaker, value)``."""
    keys = [MEDIA, "speaker"]
    stats = order_statistics(
        frames,
        keys,
        "value",
        layout,
        {"median_db": "median", "p10_db": "rounded_0.1", "p90_db": "rounded_0.9"},
        "exclusive_frames",
    )
    shares = frames.groupBy(*keys).agg(
        F.avg((F.col("value") > 0).cast("double")).alias("left_louder_fraction"),
        F.avg((F.col("value") < 0).cast("double")).alias("right_louder_fraction"),
    )
    return stats.join(shares, keys).withColumn(
        "dominant_channel",
        F.when(F.col("median_db") > 0, "channel_left").when(F.col("median_db") < 0, "channel_right"),
    )


def apply_gains(samples: DataFrame, gains: DataFrame, fade: int, chunk_len: int) -> DataFrame:
    """Multiply faded gains into the signal, chunk by chunk.

    ``gains``: ``(media_id, start, end, gain_db)`` in samples. Blends compose, so a sample is scaled by
    the product of ``1 - m + m*g`` over the gains that reach it; untouched chunks pass through.
    """
    pieces = with_buckets(gains, "start", "end", chunk_len).withColumnRenamed(BUCKET, "chunk_id")
    # Copies of a gain collapse to a count, so a chunk's list holds distinct gains only.
    counted = pieces.groupBy(MEDIA, "chunk_id", "start", "end", "gain_db").agg(F.count("*").alias("n"))
    per_chunk = counted.groupBy(MEDIA, "chunk_id").agg(
        F.array_sort(
            F.collect_list(F.struct("start", "end", L.db_to_amplitude(F.col("gain_db")).alias("g"), "n"))
        ).alias("_gains")
    )
    joined = samples.join(per_chunk, [MEDIA, "chunk_id"], "left")

    def scaled(channel: str) -> Column:
        def one(x: Column, k: Column) -> Column:
            at = F.col("start_sample") + k

            def step(acc: Column, gain: Column) -> Column:
                m = L.fade_inside(at, gain["start"], gain["end"], fade)
                return acc * F.pow(1.0 - m + m * gain["g"], gain["n"])

            factor = F.aggregate("_gains", F.lit(1.0), step)
            return (x.cast("double") * factor).cast("float")

        return F.when(F.col("_gains").isNull(), F.col(channel)).otherwise(F.transform(channel, one))

    return joined.withColumns({"ch0": scaled("ch0"), "ch1": scaled("ch1")}).drop("_gains")


def compressor_curve(samples: DataFrame, rate: int, threshold: float, ratio: float) -> DataFrame:
    """Gain reduction at the centre of every 20 ms frame over all channels."""
    frame = max(1, round(rate * 0.02))
    both = F.col("l") * F.col("l") + F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    framed = (
        samples_long(samples)
        .groupBy(MEDIA, F.floor(F.col("i") / frame).cast("bigint").alias("frame_idx"))
        .agg(F.sum(both).alias("_s"), F.max(F.when(F.col("r").isNotNull(), 2).otherwise(1)).alias("_c"))
    )
    level = 20.0 * F.log10(F.sqrt(F.col("_s") / (F.col("_c") * frame) + L.EPSILON))
    over = F.greatest(level - threshold, F.lit(0.0))
    return framed.join(signal_sizes(samples), MEDIA).select(
        MEDIA,
        "frame_idx",
        F.least(F.col("frame_idx") * frame + frame // 2, F.col("total_samples") - 1).alias("centre"),
        (-(over - over / ratio)).alias("reduction_db"),
    )


def compress(samples: DataFrame, rate: int, threshold: float, ratio: float, chunk_len: int) -> DataFrame:
    """Apply the reduction curve, linear between frame centres and flat at both ends."""
    frame = max(1, round(rate * 0.02))
    curve = compressor_curve(samples, rate, threshold, ratio)
    # A chunk needs the centres inside it and the nearest one on either side: two frames of margin.
    first = F.floor((F.col("centre") - 2 * frame) / chunk_len)
    last = F.floor((F.col("centre") + 2 * frame) / chunk_len)
    per_chunk = (
        curve.withColumn("chunk_id", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
        .groupBy(MEDIA, "chunk_id")
        .agg(F.array_sort(F.collect_list(F.struct("centre", "reduction_db"))).alias("_curve"))
    )
    joined = samples.join(per_chunk, [MEDIA, "chunk_id"])

    def scaled(channel: str) -> Column:
        def one(x: Column, k: Column) -> Column:
            at = F.col("start_sample") + k
            # Index of the last centre at or before this sample within the chunk's short curve.
            base = F.col("_curve")[0]["centre"]
            guess = F.floor((at - base) / frame).cast("int")
            index = F.greatest(F.lit(0), F.least(guess, F.size("_curve") - 1))
            index = F.when(F.get("_curve", index)["centre"] > at, index - 1).otherwise(index)
            a = F.get("_curve", F.greatest(index, F.lit(0)))
            b = F.get("_curve", F.least(F.greatest(index + 1, F.lit(0)), F.size("_curve") - 1))
            span = F.nullif(b["centre"] - a["centre"], F.lit(0))
            share = F.coalesce((at - a["centre"]) / span, F.lit(0.0))
            share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
            db = a["reduction_db"] + (b["reduction_db"] - a["reduction_db"]) * share
            return (x.cast("double") * L.db_to_amplitude(db)).cast("float")

        return F.transform(channel, one)

    return joined.withColumns({"ch0": scaled("ch0"), "ch1": scaled("ch1")}).drop("_curve")


def regional_measurements(
    samples: DataFrame, speech: DataFrame, machine: DataFrame, chunk_len: int, layout: Layout
) -> DataFrame:
    """Speech level, level of each region and its difference, and the sample peak."""
    levels = interval_levels(samples, machine.select(MEDIA, "region_id", "start", "end"), chunk_len, "region_id")
    speech_level = speech_levels(samples, speech, chunk_len, layout)
    peaks = samples.groupBy(MEDIA).agg(
        F.max(
            F.greatest(
                F.array_max(F.transform("ch0", lambda x: F.abs(x))),
                F.coalesce(F.array_max(F.transform("ch1", lambda x: F.abs(x))), F.lit(0.0)),
            )
        ).alias("_peak")
    )
    return (
        levels.join(speech_level, MEDIA)
        .join(peaks, MEDIA)
        .select(
            MEDIA,
            "region_id",
            F.col("level_dbfs").alias("measured_dbfs"),
            (F.col("level_dbfs") - F.col("speech_rms_dbfs")).alias("difference_db"),
            "speech_rms_dbfs",
            L.peak_db(F.col("_peak").cast("double")).alias("sample_peak_dbfs"),
        )
    )
