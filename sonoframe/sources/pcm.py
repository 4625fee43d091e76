"""PCM16 files of any size, each read by many tasks in ranges of bytes.

Files are listed without their content and cut into ranges of a fixed number of bytes, as a split of any other file
source is. The task of a range reads the header, a few bytes a block, and then the chunks of samples that begin within
its range, so no task and no row holds a whole file. The rows are those of ``media.parse_wav``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.session import spread
from sonoframe.sources.media import WAV_SCHEMA

RANGE_BYTES = 64 << 20
COLUMNS = [part.split()[0] for part in WAV_SCHEMA.split(", ")]


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def find_samples(source, length: int) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, first byte, bytes) of the samples; raises ValueError when unusable."""
    head = source.read_at(min(12, length), 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not_a_wave_file")
    at, form = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", source.read_at(8, at))
        body = at + 8
        if name == b"fmt ":
            if size < 16 or body + 16 > length:
                raise ValueError("truncated_header")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", source.read_at(16, body))
            form = (kind, channels, rate, bits)
        elif name == b"data":
            if form is None:
                raise ValueError("missing_format")
            if body + size > length:
                raise ValueError("short_read")
            return (*form, body, size)
        at = body + size + size % 2
    raise ValueError("missing_samples")


def _chunks(path: str, length: int, low: int, high: int, seconds: float, wanted: int | None) -> Iterator[list]:
    """Rows of the chunks that begin in bytes [low, high); an unusable file's one row is that of its first range."""
    system, place = located(path)
    with system.open_input_file(place) as source:
        try:
            kind, channels, rate, bits, first, size = find_samples(source, length)
            if kind != 1 or bits != 16:
                raise ValueError("not_pcm16")
            if channels not in (1, 2):
                raise ValueError("unsupported_channels")
            if wanted is not None and rate != wanted:
                raise ValueError("unexpected_sample_rate")
            if size % (2 * channels):
                raise ValueError("short_read")
        except ValueError as problem:
            if low == 0:
                yield [path, *[None] * (len(COLUMNS) - 2), str(problem)]
            return
        total, width = size // (2 * channels), max(1, round(rate * seconds))
        step = width * 2 * channels
        # The first chunks belong to the range that the samples begin in.
        chunk = max(0, -(-(low - first) // step))
        while chunk * width < total and first + chunk * step < high:
            raw = source.read_at(min(step, size - chunk * step), first + chunk * step)
            part = np.frombuffer(raw, "<i2").reshape(-1, channels).astype(np.float32) / np.float32(32768.0)
            yield [path, rate, channels, total, chunk, chunk * width, part[:, 0], part[:, 1] if channels == 2 else None, None]
            chunk += 1


def read_pcm(
    spark: SparkSession,
    path: str,
    pattern: str = "*",
    chunk_seconds: float = 1.0,
    rate: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Chunk rows of all files below a folder; an unusable file becomes one row with ``error`` and no samples.

    ``rate`` rejects every other sample rate. A file without samples has no row.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    ranges = listed.withColumn("low", F.explode(starts))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, length, low in zip(batch["path"], batch["length"], batch["low"]):
                for row in _chunks(file, length, low, low + range_bytes, chunk_seconds, rate):
                    yield pd.DataFrame([row], columns=COLUMNS)

    return spread(ranges, "path", "low").mapInPandas(read, WAV_SCHEMA)
