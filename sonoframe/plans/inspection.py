"""Whole-recording inspection and enhancement planning as single jobs over many recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.fingerprint import digest
from sonoframe.functions.levels import finite_or_null
from sonoframe.operators import levels, rules, spectrum
from sonoframe.operators.scan import Layout
from sonoframe.session import cut
from sonoframe.sources.profiles import with_profiles

MEDIA = "media_id"


def analyse(
    samples: DataFrame, speech: DataFrame, rate: int, chunk_len: int, layout: Layout, segment: int = 4096, minimum: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """Measures (one row per recording) and machine regions.

    ``speech(media_id, region_id, start, end)`` in samples.
    """
    regions = cut(levels.machine_regions(samples, speech, rate, chunk_len, layout))
    frames = levels.frame_levels(samples, max(1, round(rate * 0.1)))
    environment = spectrum.speech_spectrum(samples, speech, rate, chunk_len, layout, segment, minimum)
    counts = speech.groupBy(MEDIA).agg(F.count("*").alias("speech_regions"))
    measures = (
        levels.whole_measures(samples)
        .drop("dc_offset")
        .join(levels.noise_floor(frames, layout), MEDIA, "left")
        .join(levels.speech_levels(samples, speech, chunk_len, layout), MEDIA, "left")
        .join(environment, MEDIA, "left")
        .join(counts, MEDIA, "left")
        .na.fill({"speech_regions": 0, "noise_floor_dbfs": -120.0})
    )
    return cut(measures), regions


def observations(measures: DataFrame, regions: DataFrame, loudness: DataFrame) -> DataFrame:
    """Observation rows of every recording: channel, programme, and each machine region."""
    whole = measures.join(loudness, MEDIA, "left").select(
        MEDIA,
        F.inline(
            F.array(
                F.struct(
                    F.lit("channel_001").alias("observation_id"),
                    F.lit("channel").alias("type"),
                    F.col("channel_difference_db").alias("observed"),
                ),
                F.struct(
                    F.lit("program_001").alias("observation_id"),
                    F.lit("program").alias("type"),
                    F.col("integrated_lufs").alias("observed"),
                ),
            )
        ),
    )
    number = F.substring_index("region_id", "_", -1)
    regional = regions.select(
        MEDIA,
        F.concat(F.lit("level_"), number).alias("observation_id"),
        F.lit("region").alias("type"),
        F.col("difference_db").alias("observed"),
    )
    return whole.unionByName(regional)


#: What an observation row may hold beside its recording, id and type, in the order of the columns.
OBSERVED = {
    "region_id": "string",
    "start": "double",
    "end": "double",
    "left_rms_dbfs": "double",
    "right_rms_dbfs": "double",
    "difference_db": "double",
    "correlation": "double",
    "subbass_power_ratio": "double",
    "maximum_hum_excess_db": "double",
    "dc_offset": "double",
    "estimated_noise_floor_dbfs": "double",
    "measured_rms_dbfs": "double",
    "non_speech_program_detection_threshold_dbfs": "double",
    "detected_region_count": "bigint",
    "detected_duration_seconds": "double",
    "overlaps_reference": "boolean",
    "integrated_loudness_lufs": "double",
    "loudness_range_lu": "double",
    "true_peak_dbtp": "double",
}


def _observation(identity: Column, kind: str, **values: Column) -> Column:
    """A struct of all OBSERVED fields; those not given are null."""
    fields = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in OBSERVED.items()]
    return F.struct(identity.alias("observation_id"), F.lit(kind).alias("type"), *fields)


def observation_rows(measures: DataFrame, regions: DataFrame, speech: DataFrame, loudness: DataFrame, rate: int) -> DataFrame:
    """All observations of every recording: channels, environment and level of its speech, programme, and each machine region."""
    col = F.col

    def rounded(name: str, digits: int = 3) -> Column:
        return finite_or_null(col(name), digits)

    spoken = speech.groupBy(MEDIA).agg((F.sum(col("end") - col("start")) / float(rate)).alias("_spoken"))
    threshold = F.greatest(col("noise_floor_dbfs") + 15.0, col("speech_rms_dbfs") + 3.0, F.lit(-55.0))
    whole = measures.join(loudness, MEDIA, "left").join(spoken, MEDIA, "left").withColumn("_threshold", threshold)
    each = whole.select(
        MEDIA,
        F.inline(
            F.array(
                _observation(
                    F.lit("channel_001"),
                    "channel_level_difference",
                    left_rms_dbfs=rounded("left_rms_dbfs"),
                    right_rms_dbfs=rounded("right_rms_dbfs"),
                    difference_db=rounded("channel_difference_db"),
                    correlation=rounded("channel_correlation", 6),
                ),
                _observation(
                    F.lit("environment_001"),
                    "speech_environment_spectrum",
                    subbass_power_ratio=rounded("subbass_ratio", 6),
                    maximum_hum_excess_db=rounded("hum_excess_db"),
                    dc_offset=rounded("dc_offset", 9),
                    estimated_noise_floor_dbfs=rounded("noise_floor_dbfs"),
                ),
                _observation(
                    F.lit("speech_001"),
                    "speech_program_level",
                    region_id=F.lit("speech_program"),
                    measured_rms_dbfs=rounded("speech_rms_dbfs"),
                    non_speech_program_detection_threshold_dbfs=rounded("_threshold"),
                    detected_region_count=col("speech_regions"),
                    detected_duration_seconds=F.bround(F.coalesce("_spoken", F.lit(0.0)), 6),
                ),
                _observation(
                    F.lit("program_001"),
                    "program_loudness",
                    integrated_loudness_lufs=rounded("integrated_lufs"),
                    loudness_range_lu=rounded("loudness_range"),
                    true_peak_dbtp=rounded("true_peak"),
                ),
            )
        ),
    )
    number = F.substring_index("region_id", "_", -1)
    regional = regions.select(
        MEDIA,
        F.inline(
            F.array(
                _observation(
                    F.concat(F.lit("level_"), number),
                    "regional_level_difference",
                    region_id=col("region_id"),
                    start=F.bround(col("start") / float(rate), 6),
                    end=F.bround(col("end") / float(rate), 6),
                    measured_rms_dbfs=rounded("level_dbfs"),
                    difference_db=rounded("difference_db"),
                    overlaps_reference=col("overlaps_speech"),
                )
            )
        ),
    )
    return each.unionByName(regional)


def inspection_reports(measures: DataFrame, regions: DataFrame, speech: DataFrame, loudness: DataFrame, rate: int) -> DataFrame:
    """One report per recording, ``(media_id, report, sha256)``: a struct and the digest of its canonical JSON.

    Observations and regions are ordered by their ids; a report is as long as its recording has regions.
    """
    rows = observation_rows(measures, regions, speech, loudness, rate)
    observed = rows.groupBy(MEDIA).agg(
        F.array_sort(F.collect_list(F.struct("observation_id", "type", *OBSERVED))).alias("observations")
    )

    def manifest(df: DataFrame, kind: str, overlaps: Column) -> DataFrame:
        bounds = [F.bround(F.col(b) / float(rate), 6).alias(b) for b in ("start", "end")]
        return df.select(MEDIA, "region_id", F.lit(kind).alias("kind"), *bounds, overlaps.cast("boolean").alias("overlaps_speech"))

    both = manifest(speech, "speech", F.lit(None)).unionByName(manifest(regions, "non_speech_program", F.col("overlaps_speech")))
    listed = both.groupBy(MEDIA).agg(
        F.array_sort(F.collect_list(F.struct("region_id", "kind", "start", "end", "overlaps_speech"))).alias("regions")
    )
    joined = observed.join(listed, MEDIA, "left").join(measures.select(MEDIA, "total_samples"), MEDIA)
    report = F.struct(
        F.lit("1").alias("schema_version"),
        F.lit("audio_inspection").alias("kind"),
        F.bround(F.col("total_samples") / float(rate), 6).alias("duration_seconds"),
        F.col("observations"),
        F.coalesce("regions", F.array().cast(listed.schema["regions"].dataType)).alias("regions"),
    )
    built = joined.select(MEDIA, report.alias("report"))
    return built.select(MEDIA, "report", digest(F.col("report"), built.schema["report"].dataType).alias("sha256"))


def evaluations(measures: DataFrame, regions: DataFrame, loudness: DataFrame) -> DataFrame:
    return rules.evaluate_measures(with_profiles(observations(measures, regions, loudness)))


def stage_decisions(measures: DataFrame, regions: DataFrame, loudness: DataFrame) -> DataFrame:
    """Ordered stage results of every recording under every profile, before any signal is touched."""
    wide = with_profiles(measures.join(loudness, MEDIA, "left"))
    keys = [MEDIA, "profile_name"]
    named = wide.withColumn("profile_name", F.col("profile.name"))
    balanced = rules.source_balance(with_profiles(regions)).withColumn("profile_name", F.col("profile.name"))
    decided = {
        "channel-balance": rules.channel_balance(named),
        "environment-denoise": rules.environment_cleanup(named),
        "voice-enhance": rules.voice_gain(named),
        "source-balance": rules.source_balance_status(named, balanced, keys),
        "program-loudness": rules.loudness_plan(named),
    }
    rows = None
    for stage, frame in decided.items():
        part = frame.select(*keys, F.lit(stage).alias("stage"), "status", "reason")
        rows = part if rows is None else rows.unionByName(part)
    gates = rules.stage_gates(named.select(*keys, "profile"), F.array().cast("array<string>")).select(
        *keys, "stage", "stage_order", "gate"
    )
    enabled = F.col("gate") == "evaluate"
    merged = gates.join(rows, [*keys, "stage"]).select(
        *keys,
        "stage_order",
        "stage",
        F.when(enabled, F.col("status")).otherwise(F.col("gate")).alias("status"),
        F.when(enabled, F.col("reason")).otherwise("profile_stage_disabled").alias("reason"),
    )
    return rules.stage_report(merged, keys)
