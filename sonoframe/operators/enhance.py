"""Applying planned corrections to chunked signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.levels import bounded_gain, db_to_amplitude
from sonoframe.operators import filters, levels, rules
from sonoframe.operators.scan import Layout
from sonoframe.session import cut
from sonoframe.sources.profiles import profile_array

MEDIA = "media_id"


def scale(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """Multiply whole channels: ``gains(media_id, left_gain_db, right_gain_db)``, null meaning none."""
    joined = samples.join(gains, MEDIA, "left")

    def scaled(channel: str, gain: str):
        factor = db_to_amplitude(F.coalesce(F.col(gain), F.lit(0.0)))
        return F.transform(channel, lambda x: (x.cast("double") * factor).cast("float"))

    return joined.select(
        MEDIA,
        "chunk_id",
        "start_sample",
        scaled("ch0", "left_gain_db").alias("ch0"),
        scaled("ch1", "right_gain_db").alias("ch1"),
    )


def enhance_voice(
    samples: DataFrame,
    speech: DataFrame,
    treatment: DataFrame,
    profile: dict,
    rate: int,
    chunk_len: int,
    layout: Layout,
) -> tuple[DataFrame, DataFrame]:
    """Presence filter, bounded levelling and compression inside the treatment intervals.

    ``speech`` bounds the measurement and ``treatment`` (samples) where the result is heard. Returns the
    new signal and the gain decided per recording.
    """
    presence = filters.peaking(profile["voice_presence_gain_db"], min(3000.0, rate * 0.4), 0.9, rate)
    tonal = cut(filters.filter_signal(samples, [presence]))
    measured = levels.speech_levels(tonal, speech, chunk_len, layout)
    voiced = speech.select(MEDIA).distinct()
    gain = bounded_gain(
        F.lit(profile["voice_target_rms_dbfs"]),
        F.col("speech_rms_dbfs"),
        F.lit(profile["voice_max_attenuation_db"]),
        F.lit(profile["voice_max_gain_db"]),
    )
    decided = cut(measured.join(voiced, MEDIA).select(MEDIA, "speech_rms_dbfs", gain.alias("gain_db")))
    both = decided.select(
        MEDIA, F.col("gain_db").alias("left_gain_db"), F.col("gain_db").alias("right_gain_db")
    )
    levelled = scale(tonal, both)
    compressed = levels.compress(
        levelled, rate, profile["compressor_threshold_dbfs"], profile["compressor_ratio"], chunk_len
    )
    fade = max(1, round(rate * profile["region_fade_ms"] / 1000))
    return filters.blend_signals(samples, compressed, treatment, fade, chunk_len, outside=True), decided


def adjust_band(
    samples: DataFrame, intervals: DataFrame, gain_db: float, low_hz: float, high_hz: float, rate: int, chunk_len: int, fade: int
) -> DataFrame:
    """One bounded band adjustment on every recording's intervals."""
    centre = (low_hz * high_hz) ** 0.5
    quality = max(0.25, centre / (high_hz - low_hz))
    filtered = filters.filter_signal(samples, [filters.peaking(gain_db, centre, quality, rate)])
    return filters.blend_signals(samples, filtered, intervals, fade, chunk_len)


def compensate(
    samples: DataFrame,
    speech: DataFrame,
    regions: DataFrame,
    profile_name: str,
    rate: int,
    chunk_len: int,
    layout: Layout,
    passes: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Measure, correct and measure again until no region moves, at most ``passes`` times.

    ``regions``: ``(media_id, region_id, start, end, overlaps_speech)``. The driver only reads the number
    of regions still moving. Returns the signal and the total gain per region.
    """
    chosen = F.filter(profile_array(), lambda p: p["name"] == profile_name)[0]
    totals = regions.select(MEDIA, "region_id", "start", "end", "overlaps_speech", F.lit(0.0).alias("gain_db"))
    current = samples
    fade = max(1, round(rate * 0.04))
    for _ in range(passes):
        measured = levels.regional_measurements(current, speech, totals, chunk_len, layout)
        stepped = cut(
            rules.compensation_step(
                totals.join(measured.select(MEDIA, "region_id", "difference_db"), [MEDIA, "region_id"]).withColumn(
                    "profile", chosen
                )
            ).drop("profile", "difference_db")
        )
        totals = stepped.drop("delta_db")
        moving = stepped.where("delta_db <> 0").select(MEDIA, "start", "end", F.col("delta_db").alias("gain_db"))
        if moving.isEmpty():
            break
        current = cut(levels.apply_gains(current, moving, fade, chunk_len))
    return current, totals
