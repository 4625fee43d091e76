"""Programme loudness: gated block loudness, loudness range and oversampled peak."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sonoframe.operators.filters import filter_signal, weighting
from sonoframe.operators.levels import samples_long, signal_sizes
from sonoframe.operators.scan import Layout, lag, lead, running
from sonoframe.operators.statistics import order_statistics
from sonoframe.session import cut

MEDIA = "media_id"
# Gates and offset of the loudness definition.
ABSOLUTE_GATE = -70.0
RELATIVE_GATE = -10.0
RANGE_GATE = -20.0
OFFSET = -0.691


def to_lufs(power: Column) -> Column:
    return OFFSET + 10.0 * F.log10(power)


def frame_power(weighted: DataFrame, frame: int) -> DataFrame:
    """Sum of squares over all channels per 100 ms frame; an incomplete last frame is dropped."""
    both = F.col("l") * F.col("l") + F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    framed = (
        samples_long(weighted)
        .groupBy(MEDIA, F.floor(F.col("i") / frame).cast("bigint").alias("frame_idx"))
        .agg(F.sum(both).alias("square_sum"))
    )
    sizes = signal_sizes(weighted)
    return framed.join(sizes, MEDIA).where((F.col("frame_idx") + 1) * frame <= F.col("total_samples")).drop(
        "total_samples"
    )


def block_power(frames: DataFrame, frame: int, length: int) -> DataFrame:
    """Mean power of blocks of ``length`` frames starting at every frame.

    Each frame adds itself to the blocks it belongs to: bounded fan-out, partial sums, no window.
    """
    starts = F.sequence(F.greatest(F.lit(0), F.col("frame_idx") - (length - 1)), F.col("frame_idx"))
    spread = frames.select(MEDIA, F.explode(starts).alias("block"), "square_sum")
    return (
        spread.groupBy(MEDIA, "block")
        .agg(F.sum("square_sum").alias("_s"), F.count("*").alias("_n"))
        .where(F.col("_n") == length)
        .select(MEDIA, "block", (F.col("_s") / (length * frame)).alias("power"))
    )


def gated(blocks: DataFrame, relative: float) -> DataFrame:
    """Blocks above the absolute gate and above the gate relative to their own mean."""
    loud = blocks.where((F.col("power") > 0) & (to_lufs(F.col("power")) > ABSOLUTE_GATE))
    means = loud.groupBy(MEDIA).agg((to_lufs(F.avg("power")) + relative).alias("_gate"))
    return loud.join(means, MEDIA).where(to_lufs(F.col("power")) > F.col("_gate"))


def integrated(blocks: DataFrame) -> DataFrame:
    kept = gated(blocks, RELATIVE_GATE)
    return kept.groupBy(MEDIA).agg(
        to_lufs(F.avg("power")).alias("integrated_lufs"), F.max("_gate").alias("threshold_lufs")
    )


def loudness_range(short_term: DataFrame, layout: Layout) -> DataFrame:
    kept = gated(short_term, RANGE_GATE).select(MEDIA, to_lufs(F.col("power")).alias("lufs"))
    picks = {"_low": "linear_0.1", "_high": "linear_0.95"}
    return order_statistics(kept, [MEDIA], "lufs", layout, picks).select(
        MEDIA, (F.col("_high") - F.col("_low")).alias("loudness_range")
    )


TAPS = 12


def _oversampler() -> np.ndarray:
    """Four-phase windowed-sinc interpolator with ``TAPS`` samples on either side."""
    k = np.arange(-4 * TAPS, 4 * TAPS + 1)
    kernel = np.sinc(k / 4.0) * np.hanning(len(k) + 2)[1:-1]
    return kernel


@pandas_udf(T.DoubleType())
def oversampled_peak(before: pd.Series, body: pd.Series, after: pd.Series) -> pd.Series:
    """Largest magnitude of the four-times oversampled chunk, with its neighbours' edges as context."""
    kernel = _oversampler()
    out = []
    for left, middle, right in zip(before, body, after):
        if middle is None:
            out.append(np.nan)
            continue
        edges = [np.asarray([] if e is None else e, dtype=np.float64) for e in (left, right)]
        x = np.concatenate([edges[0], np.asarray(middle, dtype=np.float64), edges[1]])
        stuffed = np.zeros(4 * len(x))
        stuffed[::4] = x
        fine = np.convolve(stuffed, kernel, mode="same")
        start = 4 * len(edges[0])
        out.append(float(np.abs(fine[start : start + 4 * len(middle)]).max()))
    return pd.Series(out)


def true_peak(samples: DataFrame, layout: Layout) -> DataFrame:
    """Oversampled peak in dB; each chunk borrows a few samples from its neighbours."""

    def edge(channel: str, last: bool) -> Column:
        kept = F.least(F.lit(TAPS), F.size(channel))
        return F.slice(channel, -kept if last else F.lit(1), kept)

    # Only the edges travel between chunks, not the chunks.
    edges = samples.select(
        MEDIA,
        "chunk_id",
        F.struct(edge("ch0", True).alias("a"), edge("ch1", True).alias("b")).alias("_tail"),
        F.struct(edge("ch0", False).alias("a"), edge("ch1", False).alias("b")).alias("_head"),
    )
    around = running(
        edges, [MEDIA], ["chunk_id"], layout, _before=lag(F.col("_tail")), _after=lead(F.col("_head"))
    ).drop("_tail", "_head")
    peaks = samples.join(around, [MEDIA, "chunk_id"]).select(
        MEDIA,
        F.greatest(
            F.nanvl(oversampled_peak("_before.a", "ch0", "_after.a"), F.lit(None).cast("double")),
            F.nanvl(oversampled_peak("_before.b", "ch1", "_after.b"), F.lit(None).cast("double")),
        ).alias("_peak"),
    )
    return peaks.groupBy(MEDIA).agg(
        (20.0 * F.log10(F.nullif(F.max("_peak"), F.lit(0.0)))).alias("true_peak")
    )


def program_loudness(samples: DataFrame, rate: int, layout: Layout) -> DataFrame:
    """Integrated loudness, gate, range and true peak; null where no block can be measured."""
    frame = round(rate * 0.1)
    weighted = filter_signal(samples, weighting(rate))
    frames = cut(frame_power(weighted, frame))
    measured = integrated(block_power(frames, frame, 4))
    ranges = loudness_range(block_power(frames, frame, 30), layout)
    everyone = samples.select(MEDIA).distinct()
    return (
        everyone.join(measured, MEDIA, "left")
        .join(ranges, MEDIA, "left")
        .join(true_peak(samples, layout), MEDIA, "left")
    )
