"""The two versioned processing profiles as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stage order and shipped parameters.
STAGE_ORDER = (
    "channel-balance",
    "environment-denoise",
    "voice-enhance",
    "source-balance",
    "program-loudness",
)

SHARED = {
    "version": "4",
    "channel_balance_enabled": True,
    "channel_no_op_db": 1.5,
    "channel_max_correction_db": 6.0,
    "channel_correlation_minimum": 0.92,
    "environment_denoise_enabled": True,
    "voice_enhance_enabled": True,
    "voice_max_attenuation_db": 4.0,
    "compressor_threshold_dbfs": -24.0,
    "machine_relative_minimum_lu": -4.0,
    "machine_relative_maximum_lu": -2.0,
    "machine_relative_target_lu": -3.0,
    "program_loudness_enabled": True,
    "codec_true_peak_headroom_db": 1.0,
    "vad_threshold": 0.5,
    "vad_exit_threshold": 0.35,
    "vad_min_speech_ms": 100,
    "vad_min_silence_ms": 300,
    "vad_speech_pad_ms": 120,
    "region_fade_ms": 40,
    "speech_transition_placement": "outside",
    "voice_boundary_bridge_silence_ms": 400,
    "voice_boundary_guard_ms": 80,
    "voice_boundary_search_ms": 2000,
    "voice_boundary_noise_margin_db": 6.0,
    "voice_boundary_speech_margin_db": 12.0,
}

PROFILES = {
    "transcription": {
        **SHARED,
        "highpass_hz": 70.0,
        "subbass_ratio_threshold": 0.025,
        "hum_excess_db_threshold": 9.0,
        "voice_target_rms_dbfs": -28.0,
        "voice_max_gain_db": 20.0,
        "voice_presence_gain_db": 1.5,
        "compressor_ratio": 2.0,
        "source_balance_enabled": False,
        "machine_max_boost_db": 0.0,
        "machine_max_attenuation_db": 0.0,
        "target_lufs": -23.0,
        "target_lra_lu": 7.0,
        "target_true_peak_dbtp": -3.0,
    },
    "product-demo": {
        **SHARED,
        "highpass_hz": 75.0,
        "subbass_ratio_threshold": 0.02,
        "hum_excess_db_threshold": 8.0,
        "voice_target_rms_dbfs": -30.0,
        "voice_max_gain_db": 24.0,
        "voice_presence_gain_db": 2.0,
        "compressor_ratio": 2.5,
        "source_balance_enabled": True,
        "machine_max_boost_db": 12.0,
        "machine_max_attenuation_db": 30.0,
        "target_lufs": -16.0,
        "target_lra_lu": 11.0,
        "target_true_peak_dbtp": -1.5,
    },
}


def profile(name: str) -> dict:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; choose one of {', '.join(sorted(PROFILES))}")
    return {"name": name, **PROFILES[name]}


def profile_table(spark: SparkSession) -> DataFrame:
    """Two rows, whatever the data."""
    return spark.createDataFrame([profile(name) for name in sorted(PROFILES)])


def profile_array() -> Column:
    """The profiles as one literal array, to be unfolded next to any row without a join."""
    rows = []
    for name in sorted(PROFILES):
        fields = sorted(profile(name).items())
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in fields]))
    return F.array(*rows)


def with_profiles(df: DataFrame) -> DataFrame:
    """Every row beside every profile (struct column ``profile``)."""
    return df.withColumn("profile", F.explode(profile_array()))
