"""Rule evaluation and correction planning: every decision is a status and a reason, never a failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.levels import bounded_gain, clip, finite_or_null
from sonoframe.sources.profiles import STAGE_ORDER

MEDIA = "media_id"


def _p(name: str) -> Column:
    return F.col("profile")[name]


def stage_gates(media: DataFrame, skipped: Column) -> DataFrame:
    """One row per stage in fixed order: skipped, then disabled, then to be evaluated."""
    stages = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_order"),
                F.lit(name).alias("stage"),
                _p(name.replace("-", "_") + "_enabled").alias("_enabled"),
            )
            for i, name in enumerate(STAGE_ORDER)
        ]
    )
    gated = media.select("*", F.inline(stages))
    return gated.withColumn(
        "gate",
        F.when(F.array_contains(skipped, F.col("stage")), "skipped")
        .when(~F.col("_enabled"), "disabled")
        .otherwise("evaluate"),
    ).drop("_enabled")


def skip_list(raw: Column) -> Column:
    """Parse a comma-separated stage list to ``struct<stages, error>``."""
    items = F.transform(F.split(raw, ","), lambda x: F.trim(x))
    known = F.array(*[F.lit(s) for s in STAGE_ORDER])
    unknown = F.array_sort(F.array_except(items, known))
    none = F.array().cast("array<string>")
    blank = raw.isNull() | (F.length(F.trim(raw)) == 0)
    error = (
        F.when(blank, None)
        .when(F.exists(items, lambda x: F.length(x) == 0), "empty_item")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, "|")))
        .when(F.size(F.array_distinct(items)) < F.size(items), "duplicate")
    )
    stages = F.when(blank | error.isNotNull(), none).otherwise(items)
    return F.struct(stages.alias("stages"), error.alias("error"))


def channel_balance(measures: DataFrame) -> DataFrame:
    """Symmetric bounded gains for correlated channels whose levels differ."""
    difference, correlation = F.col("channel_difference_db"), F.col("channel_correlation")
    uncertain = correlation.isNull() | (correlation < _p("channel_correlation_minimum"))
    small = F.abs(difference) <= _p("channel_no_op_db")
    status = (
        F.when((F.col("channels") == 1) | small, "no_op").when(uncertain, "abstained").otherwise("applied")
    )
    reason = (
        F.when(F.col("channels") == 1, "mono_source")
        .when(small, "channel_difference_below_threshold")
        .when(uncertain, "stereo_difference_may_be_intentional")
        .otherwise("correlated_channels_with_level_mismatch")
    )
    limit = _p("channel_max_correction_db")
    half = clip(difference / 2.0, -limit, limit)
    return measures.withColumns(
        {
            "status": status,
            "reason": reason,
            "left_gain_db": F.when(status == "applied", -half),
            "right_gain_db": F.when(status == "applied", half),
        }
    )


def environment_cleanup(measures: DataFrame) -> DataFrame:
    """High-pass, de-hum and broadband decisions with the overall status precedence."""
    highpass = (F.col("subbass_ratio") >= _p("subbass_ratio_threshold")) | (F.abs("dc_offset") > 1e-4)
    dehum = F.col("hum_excess_db") >= _p("hum_excess_db_threshold")
    quiet = F.col("speech_rms_dbfs") < -45.0
    clean = F.col("noise_floor_dbfs") <= F.col("speech_rms_dbfs") - 20.0
    broadband = F.when(~quiet & clean, "no_op").otherwise("abstained")
    broadband_reason = (
        F.when(quiet, "input_speech_too_quiet_for_reliable_noise_estimate")
        .when(clean, "stationary_noise_below_threshold")
        .otherwise("conservative_v1_has_no_reliable_stationary_noise_profile")
    )
    silent = F.col("speech_regions") == 0
    none = F.array().cast("array<string>")
    operations = F.array_compact(
        F.array(
            F.when(highpass, F.lit("minimum-phase-highpass")),
            F.when(dehum, F.lit("minimum-phase-dehum")),
        )
    )
    some = F.size(operations) > 0
    return measures.withColumns(
        {
            "operations": F.when(silent, none).otherwise(operations),
            "broadband_status": F.when(~silent, broadband),
            "status": F.when(silent, "abstained")
            .when(some, "applied")
            .when(broadband == "abstained", "abstained")
            .otherwise("no_op"),
            "reason": F.when(silent, "no_speech_detected")
            .when(some, "eligible_environmental_cleanup_resolved")
            .when(broadband == "abstained", broadband_reason)
            .otherwise("environmental_components_below_threshold"),
        }
    )


def voice_gain(measures: DataFrame) -> DataFrame:
    """Bounded gain from the measured speech level to the profile's voice target."""
    silent = F.col("speech_regions") == 0
    gain = bounded_gain(
        _p("voice_target_rms_dbfs"),
        F.col("speech_rms_dbfs"),
        _p("voice_max_attenuation_db"),
        _p("voice_max_gain_db"),
    )
    return measures.withColumns(
        {
            "status": F.when(silent, "abstained").otherwise("applied"),
            "reason": F.when(silent, "no_speech_detected").otherwise(
                "speech_regions_received_bounded_tonal_and_level_correction"
            ),
            "resolved_gain_db": F.when(~silent, gain),
        }
    )


def source_balance(regions: DataFrame) -> DataFrame:
    """Per region: abstain on overlap, keep inside the band, else a bounded gain to the target.

    Regions are disjoint and fades stay inside them, so all gains follow from one measurement.
    """
    difference = F.col("difference_db")
    inside = difference.between(_p("machine_relative_minimum_lu"), _p("machine_relative_maximum_lu"))
    requested = _p("machine_relative_target_lu") - difference
    decision = (
        F.when(F.col("overlaps_speech"), "abstained").when(inside, "inside_target").otherwise("gain")
    )
    gain = clip(requested, -_p("machine_max_attenuation_db"), _p("machine_max_boost_db"))
    return regions.withColumns(
        {
            "decision": decision,
            "requested_gain_db": F.when(decision == "gain", requested),
            "resolved_gain_db": F.when(decision == "gain", gain),
        }
    )


def source_balance_status(media: DataFrame, balanced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage status per recording: applied over abstained over no_op."""

    def times(decision: str) -> Column:
        return F.count(F.when(F.col("decision") == decision, F.lit(1)))

    counts = balanced.groupBy(*keys).agg(
        times("gain").alias("gains"),
        times("abstained").alias("abstained"),
        times("inside_target").alias("inside_target"),
    )
    joined = media.join(counts, list(keys), "left").na.fill(
        {"gains": 0, "abstained": 0, "inside_target": 0}
    )
    silent = F.col("speech_regions") == 0
    nothing = (F.col("gains") + F.col("abstained") + F.col("inside_target")) == 0
    return joined.withColumns(
        {
            "status": F.when(silent, "abstained")
            .when(nothing, "no_op")
            .when(F.col("gains") > 0, "applied")
            .when(F.col("abstained") > 0, "abstained")
            .otherwise("no_op"),
            "reason": F.when(silent, "no_speech_reference")
            .when(nothing, "no_non_speech_program_regions")
            .when(F.col("gains") > 0, "non_overlapping_regions_balanced_to_speech_reference")
            .when(F.col("abstained") > 0, "speech_and_machine_audio_overlap")
            .otherwise("all_machine_regions_inside_target"),
        }
    )


def loudness_plan(programs: DataFrame) -> DataFrame:
    """Whether and how far to normalise programme loudness; unmeasurable input is told apart."""

    def finite(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != F.lit(float("inf")))

    measured = finite("integrated_lufs") & finite("loudness_range") & finite("true_peak")
    needed = (F.abs(F.col("integrated_lufs") - _p("target_lufs")) > 0.5) | (
        F.col("true_peak") > _p("target_true_peak_dbtp")
    )
    calm = F.col("loudness_range") <= _p("target_lra_lu")
    return programs.withColumns(
        {
            "status": F.when(~measured, "unmeasurable").when(needed, "applied").otherwise("no_op"),
            "reason": F.when(~measured & finite("true_peak"), "too_short_to_measure")
            .when(~measured, "silent")
            .when(needed, "program_outside_profile_target")
            .otherwise("program_inside_target"),
            "gain_db": F.when(measured & needed, _p("target_lufs") - F.col("integrated_lufs")),
            "range_status": F.when(measured & needed, F.when(calm, "no_op").otherwise("abstained")),
        }
    )


def evaluate_measures(observations: DataFrame) -> DataFrame:
    """Profile evaluation rows: channel difference, programme loudness, each region's level."""
    value = F.col("observed")
    inside = (
        F.when(F.col("type") == "channel", F.abs(value) <= _p("channel_no_op_db"))
        .when(F.col("type") == "program", F.abs(F.coalesce(value, F.lit(-240.0)) - _p("target_lufs")) <= 0.5)
        .otherwise(
            value.between(_p("machine_relative_minimum_lu"), _p("machine_relative_maximum_lu"))
        )
    )
    rule = (
        F.when(F.col("type") == "channel", "channel-level-difference")
        .when(F.col("type") == "program", "program-loudness")
        .otherwise("machine-audio-relative-level")
    )
    return observations.select(
        MEDIA,
        "observation_id",
        F.concat(_p("name"), F.lit("."), rule).alias("rule"),
        finite_or_null(value).alias("observed_db"),
        F.when(inside, "inside_target").otherwise("outside_target").alias("status"),
    )


def compensation_step(regions: DataFrame) -> DataFrame:
    """One correction pass: new total gain and delta per region; small deltas and overlaps are left.

    ``regions``: ``difference_db``, ``gain_db`` (so far), ``overlaps_speech``.
    """
    difference = F.col("difference_db")
    inside = difference.between(_p("machine_relative_minimum_lu"), _p("machine_relative_maximum_lu"))
    total = clip(
        F.col("gain_db") + _p("machine_relative_target_lu") - difference,
        -_p("machine_max_attenuation_db"),
        _p("machine_max_boost_db"),
    )
    delta = total - F.col("gain_db")
    moves = ~F.col("overlaps_speech") & ~inside & (F.abs(delta) >= 0.05)
    return regions.withColumns(
        {
            "delta_db": F.when(moves, delta).otherwise(0.0),
            "gain_db": F.when(moves, total).otherwise(F.col("gain_db")),
        }
    )


def final_region_status(regions: DataFrame) -> DataFrame:
    """Verdict per region after rendering."""
    difference, gain = F.col("difference_db"), F.coalesce(F.col("gain_db"), F.lit(0.0))
    inside = difference.between(
        _p("machine_relative_minimum_lu") - 0.25, _p("machine_relative_maximum_lu") + 0.25
    )
    bounded = (F.abs(gain - _p("machine_max_boost_db")) <= 0.05) | (
        F.abs(gain + _p("machine_max_attenuation_db")) <= 0.05
    )
    return regions.withColumn(
        "status",
        F.when(F.col("overlaps_speech"), "abstained_overlap")
        .when(inside, "inside_target")
        .when(bounded, "bounded_outside_target")
        .otherwise("outside_target"),
    )


def conformance(renders: DataFrame) -> DataFrame:
    """Duration, loudness and peak checks of a rendered recording as columns.

    ``renders``: source and output durations, ``after_lufs``, ``after_true_peak``, ``loudness_gate``.
    """
    skipped = F.col("loudness_gate") == "skipped"
    limit = F.when(skipped, -0.1).otherwise(_p("target_true_peak_dbtp"))
    relaxed = F.col("loudness_gate") != "evaluate"
    delta = 1000.0 * (F.col("output_duration") - F.col("source_duration"))
    checked = renders.withColumns(
        {
            "duration_delta_ms": delta,
            "timeline_ok": F.abs(delta) <= 50.0,
            "loudness_ok": relaxed | (F.abs(F.col("after_lufs") - _p("target_lufs")) <= 0.6),
            "peak_ok": F.col("after_true_peak") <= limit,
        }
    )
    return checked.withColumn(
        "conforms", F.col("timeline_ok") & F.col("loudness_ok") & F.col("peak_ok")
    )


def stage_report(stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage results of each recording as one ordered array: never more than the five stages."""
    packed = F.array_sort(
        F.collect_list(F.struct("stage_order", "stage", "status", "reason"))
    )
    return stages.groupBy(*keys).agg(packed.alias("stages"))


def adjustment_placement(adjustment: Column, duration: Column) -> Column:
    """Where a bounded gain applies in the stage order, with its resolved end."""
    banded = adjustment["low_hz"].isNotNull()
    full_time = (adjustment["start"] == 0.0) & adjustment["end"].isNull()
    return F.struct(
        F.when(banded, "before-voice-enhance")
        .when(~full_time, "after-source-balance")
        .otherwise("before-program-loudness")
        .alias("placement"),
        F.coalesce(adjustment["end"], duration).alias("resolved_end"),
    )
