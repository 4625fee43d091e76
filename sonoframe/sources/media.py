"""Media files as tables: inventory, PCM ingest, probe documents and integrity."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("bytes"), "content")
    )


def inventory(files: DataFrame) -> DataFrame:
    """Path, size and content digest of every file."""
    return files.select("path", "bytes", F.sha2("content", 256).alias("sha256"))


WAV_SCHEMA = (
    "path string, sample_rate int, channels int, total_samples bigint, chunk_id bigint, "
    "start_sample bigint, ch0 array<float>, ch1 array<float>, error string"
)


def _wav_parts(data: bytes) -> tuple[int, int, int, int, memoryview]:
    """(format, channels, rate, bits, sample bytes) of a RIFF file; raises ValueError when unusable."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not_a_wave_file")
    at, header = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        body = at + 8
        if name == b"fmt ":
            if size < 16 or body + 16 > len(data):
                raise ValueError("truncated_header")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            header = (kind, channels, rate, bits)
        elif name == b"data":
            if header is None:
                raise ValueError("missing_format")
            if body + size > len(data):
                raise ValueError("short_read")
            return (*header, memoryview(data)[body : body + size])
        at = body + size + size % 2
    raise ValueError("missing_samples")


def parse_wav(files: DataFrame, chunk_seconds: float = 1.0, rate: int | None = None) -> DataFrame:
    """PCM16 files to chunk rows; an unusable file becomes one row with ``error`` and no samples.

    ``files``: ``path`` and ``content``. ``rate`` rejects every other sample rate.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in WAV_SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    kind, channels, found, bits, raw = _wav_parts(bytes(content))
                    if kind != 1 or bits != 16:
                        raise ValueError("not_pcm16")
                    if channels not in (1, 2):
                        raise ValueError("unsupported_channels")
                    if rate is not None and found != rate:
                        raise ValueError("unexpected_sample_rate")
                    values = np.frombuffer(raw, dtype="<i2")
                    if len(values) % channels:
                        raise ValueError("short_read")
                except ValueError as problem:
                    row = [path, None, None, None, None, None, None, None, str(problem)]
                    yield pd.DataFrame([row], columns=columns)
                    continue
                signal = values.reshape(-1, channels).astype(np.float32) / np.float32(32768.0)
                size = max(1, round(found * chunk_seconds))
                for start in range(0, len(signal), size):
                    part = signal[start : start + size]
                    row = [
                        path,
                        found,
                        channels,
                        len(signal),
                        start // size,
                        start,
                        part[:, 0],
                        part[:, 1] if channels == 2 else None,
                        None,
                    ]
                    yield pd.DataFrame([row], columns=columns)

    return files.select("path", "content").mapInPandas(parse, WAV_SCHEMA)


STREAM = "struct<codec_type:string,codec_name:string,duration:string,start_time:string,sample_rate:string,channels:int,channel_layout:string>"
PROBE = f"streams array<{STREAM}>, format struct<duration:string,format_name:string,tags:map<string,string>>"


def probe_facts(documents: DataFrame, json: str = "json") -> DataFrame:
    """Facts of the first audio stream of probe documents; ``error`` marks those without one."""
    parsed = documents.withColumn("_p", F.from_json(json, PROBE))
    audio = F.filter("_p.streams", lambda s: s["codec_type"] == "audio")
    first = F.get(audio, F.lit(0))
    duration = F.coalesce(first["duration"], F.col("_p.format.duration"), F.lit("0"))
    zero = F.lit(0.0)
    return parsed.withColumn("_a", first).select(
        *documents.columns,
        F.when(F.col("_p").isNull(), "invalid_json").when(F.col("_a").isNull(), "no_audio_stream").alias("error"),
        F.bround(duration.cast("double"), 6).alias("duration_seconds"),
        F.bround(F.coalesce(F.col("_a.start_time").cast("double"), zero), 6).alias("audio_start_seconds"),
        F.coalesce(F.col("_a.sample_rate").cast("int"), F.lit(0)).alias("sample_rate_hz"),
        F.coalesce(F.col("_a.channels"), F.lit(0)).alias("channels"),
        F.col("_a.codec_name").alias("audio_codec"),
        F.coalesce(F.exists("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(False)).alias("has_video"),
        F.col("_p.format.format_name").alias("format_name"),
        F.col("_p.format.tags").alias("tags"),
    )


def already_processed(tags: Column, marker: str) -> Column:
    """Whether the tag values, read as one lower-case text, carry the marker."""
    text = F.lower(F.array_join(F.map_values(tags), " "))
    return F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))


def integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected against found files: missing, changed, drifted facts, unexpected, or ok.

    Both sides: ``path, sha256, duration_ms, sample_rate_hz, channels``.
    """
    facts = ["sha256", "duration_ms", "sample_rate_hz", "channels"]
    actual = found.withColumnsRenamed({c: f"found_{c}" for c in facts}).withColumn("_f", F.lit(True))
    joined = expected.withColumn("_e", F.lit(True)).join(actual, "path", "full")
    drifted = (
        (F.abs(F.col("found_duration_ms") - F.col("duration_ms")) > 1)
        | ~F.col("found_sample_rate_hz").eqNullSafe(F.col("sample_rate_hz"))
        | ~F.col("found_channels").eqNullSafe(F.col("channels"))
    )
    status = (
        F.when(F.col("_f").isNull(), "missing")
        .when(F.col("_e").isNull(), "unexpected")
        .when(~F.col("sha256").eqNullSafe(F.col("found_sha256")), "changed")
        .when(drifted, "facts_drift")
        .otherwise("ok")
    )
    return joined.select("path", status.alias("status"))
