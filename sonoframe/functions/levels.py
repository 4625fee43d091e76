"""Level, gain and fade arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors of the two level formulas, which differ on purpose.
EPSILON = 1e-12
EMPTY_DB = -240.0
PCM_FLOOR_DB = -120.0
PCM_SCALE = 32768.0


def amplitude_to_db(value: Column) -> Column:
    return 20.0 * F.log10(F.greatest(F.abs(value), F.lit(EPSILON)))


def db_to_amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def rms_db(square_sum: Column, count: Column) -> Column:
    """Level of ``count`` samples from their sum of squares; empty input has its own floor."""
    level = amplitude_to_db(F.sqrt(square_sum / F.nullif(count, F.lit(0)) + EPSILON))
    return F.coalesce(level, F.lit(EMPTY_DB))


def peak_db(peak: Column) -> Column:
    return F.coalesce(amplitude_to_db(peak), F.lit(EMPTY_DB))


def frame_db(square_sum: Column, frame: int) -> Column:
    """Frame level over the whole frame length, so a short last frame counts as zero-padded."""
    return 20.0 * F.log10(F.sqrt(square_sum / F.lit(float(frame)) + EPSILON))


def pcm_db(square_sum: Column, count: Column) -> Column:
    """Level of integer samples with the hard floor of the PCM formula."""
    silent = (square_sum <= 0) | (count <= 0)
    level = 20.0 * F.log10(F.sqrt(square_sum / count) / PCM_SCALE)
    return F.when(silent, PCM_FLOOR_DB).otherwise(F.greatest(F.lit(PCM_FLOOR_DB), level))


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def bounded_gain(target: Column, measured: Column, attenuation: Column, boost: Column) -> Column:
    return clip(target - measured, -attenuation, boost)


def finite_or_null(value: Column, digits: int = 3) -> Column:
    """Half-even rounding for reports; NaN and infinities become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, F.bround(value, digits))


def _ramp(step: Column, width: Column) -> Column:
    return F.pow(F.sin(F.lit(math.pi / 2) * step / width), F.lit(2.0))


def fade_inside(at: Column, start: Column, end: Column, fade: int) -> Column:
    """Weight of sample ``at`` for ``[start, end)`` with equal-power ramps inside the interval."""
    width = F.least(F.lit(fade), F.greatest(F.lit(1), F.floor((end - start) / 2)))
    head, tail = at - start, end - 1 - at
    return (
        F.when((at < start) | (at >= end), 0.0)
        .when(tail < width, _ramp(tail, width))
        .when(head < width, _ramp(head, width))
        .otherwise(1.0)
    )


def fade_outside(at: Column, start: Column, end: Column, fade: int, total: Column) -> Column:
    """Weight with full strength on ``[start, end)`` and ramps in the surrounding samples."""
    left = F.greatest(F.lit(0), start - fade)
    right = F.least(total, end + fade)
    return (
        F.when((at >= start) & (at < end), 1.0)
        .when((at >= left) & (at < start), _ramp(at - left, F.nullif(start - left, F.lit(0))))
        .when((at >= end) & (at < right), _ramp(right - at, F.nullif(right - end, F.lit(0))))
        .otherwise(0.0)
    )


def blend(original: Column, processed: Column, weight: Column) -> Column:
    return original * (1.0 - weight) + processed * weight


def timeline_bound(end: Column, source_samples: Column, source_rate: Column, rate: int = 16_000) -> Column:
    """A region end never lies past the floor of the resampled signal length."""
    return F.least(end, F.floor(source_samples.cast("bigint") * rate / source_rate) / float(rate))


def band_centre(low: Column, high: Column) -> Column:
    return F.sqrt(low * high)


def band_quality(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.25), band_centre(low, high) / (high - low))


def peaking_coefficients(gain_db: Column, centre: Column, quality: Column, rate: Column) -> Column:
    """Normalised peaking biquad as a struct ``b0, b1, b2, a1, a2``."""
    amplitude = F.pow(F.lit(10.0), gain_db / 40.0)
    omega = F.lit(2 * math.pi) * centre / rate
    alpha = F.sin(omega) / (2.0 * quality)
    a0 = 1.0 + alpha / amplitude
    turn = -2.0 * F.cos(omega) / a0
    return F.struct(
        ((1.0 + alpha * amplitude) / a0).alias("b0"),
        turn.alias("b1"),
        ((1.0 - alpha * amplitude) / a0).alias("b2"),
        turn.alias("a1"),
        ((1.0 - alpha / amplitude) / a0).alias("a2"),
    )
