"""Averaged spectra of selected samples: sub-bass share and hum excess."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sonoframe.functions.levels import EPSILON
from sonoframe.operators.levels import interval_slices
from sonoframe.operators.regions import merge_intervals
from sonoframe.operators.scan import Layout, running, running_sum

MEDIA = "media_id"
# Hum centres and band edges in Hz.
HUM_CENTRES = (60.0, 120.0, 180.0)


@pandas_udf(T.ArrayType(T.DoubleType()))
def periodogram(windows: pd.Series, rates: pd.Series) -> pd.Series:
    """One-sided power density of mean-removed, Hann-weighted windows."""
    out = []
    for values, rate in zip(windows, rates):
        x = np.asarray(values, dtype=np.float64)
        n = len(x)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        power = np.abs(np.fft.rfft((x - x.mean()) * hann)) ** 2 / (rate * (hann**2).sum())
        power[1 : (n + 1) // 2] *= 2
        out.append(power)
    return pd.Series(out)


def selected_pieces(samples: DataFrame, intervals: DataFrame, chunk_len: int, layout: Layout) -> DataFrame:
    """Selected samples laid end to end: mono pieces with their offset in the joined signal."""
    union = merge_intervals(intervals.select(MEDIA, "start", "end"), [MEDIA], layout)
    slices = interval_slices(samples, union, chunk_len)
    mono = F.when(F.col("ch1").isNull(), F.transform("ch0", lambda x: x.cast("double"))).otherwise(
        F.zip_with("ch0", "ch1", lambda a, b: (a.cast("double") + b.cast("double")) / 2.0)
    )
    sized = slices.select(MEDIA, "start_sample", mono.alias("mono")).withColumn(
        "n", F.size("mono").cast("bigint")
    )
    return running(
        sized, [MEDIA], ["start_sample"], layout, offset=running_sum(F.col("n"), inclusive=False)
    )


def averaged_spectrum(
    pieces: DataFrame, rate: float, segment: int = 4096, minimum: int = 1024
) -> DataFrame:
    """Mean power per frequency bin over half-overlapping windows ``(media_id, frequency, power)``.

    Every piece is cut to the windows it reaches, so a task holds single windows and the averages
    combine partially. Signals under ``minimum`` samples give no rows.
    """
    sizes = pieces.groupBy(MEDIA).agg(F.sum("n").alias("_size")).where(F.col("_size") >= minimum)
    length = F.least(F.lit(segment), F.col("_size"))
    planned = pieces.join(sizes, MEDIA).withColumns(
        {"_len": length, "_hop": length - F.floor(length / 2)}
    )
    windows = F.floor((F.col("_size") - (F.col("_len") - F.col("_hop"))) / F.col("_hop"))
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - F.col("_len")) / F.col("_hop")) + 1)
    last = F.least(windows - 1, F.floor((F.col("offset") + F.col("n") - 1) / F.col("_hop")))
    reached = planned.withColumns({"_first": first, "_last": last}).where("_last >= _first")
    cut_up = reached.withColumn("window", F.explode(F.sequence("_first", "_last"))).withColumn(
        "_from", F.col("window") * F.col("_hop")
    )
    low = F.greatest(F.lit(0), F.col("_from") - F.col("offset")).cast("int")
    high = F.least(F.col("n"), F.col("_from") + F.col("_len") - F.col("offset")).cast("int")
    parts = cut_up.select(
        MEDIA, "window", "_len", "offset", F.slice("mono", low + 1, high - low).alias("part")
    )
    ordered = F.array_sort(F.collect_list(F.struct("offset", "part")))
    assembled = parts.groupBy(MEDIA, "window", "_len").agg(
        F.flatten(F.transform(ordered, lambda p: p["part"])).alias("_x")
    )
    spectra = assembled.select(MEDIA, "_len", periodogram("_x", F.lit(float(rate))).alias("_p"))
    return (
        spectra.select(MEDIA, "_len", F.posexplode("_p").alias("bin", "power"))
        .groupBy(MEDIA, (F.col("bin") * float(rate) / F.col("_len")).alias("frequency"))
        .agg(F.avg("power").alias("power"))
    )


def band_metrics(spectrum: DataFrame, rate: float) -> DataFrame:
    """Sub-bass share of the voice band and the largest hum excess, per recording."""
    f, p = F.col("frequency"), F.col("power")
    voice = (f >= 20.0) & (f <= min(8000.0, rate / 2 - 1))
    aggregates = [
        (F.coalesce(F.sum(F.when(voice, p)), F.lit(0.0)) + EPSILON).alias("_total"),
        F.coalesce(F.sum(F.when((f >= 20.0) & (f < 70.0), p)), F.lit(0.0)).alias("_sub"),
    ]
    for i, centre in enumerate(HUM_CENTRES):
        off = F.abs(f - centre)
        aggregates.append(F.max(F.when(off <= 1.5, p)).alias(f"_peak{i}"))
        aggregates.append(F.median(F.when((off >= 4.0) & (off <= 12.0), p)).alias(f"_around{i}"))
    excess = [
        10.0 * F.log10((F.col(f"_peak{i}") + EPSILON) / (F.col(f"_around{i}") + EPSILON))
        for i in range(len(HUM_CENTRES))
    ]
    return spectrum.groupBy(MEDIA).agg(*aggregates).select(
        MEDIA,
        (F.col("_sub") / F.col("_total")).alias("subbass_ratio"),
        F.coalesce(F.greatest(*excess), F.lit(0.0)).alias("hum_excess_db"),
    )


def speech_spectrum(
    samples: DataFrame, speech: DataFrame, rate: float, chunk_len: int, layout: Layout, segment: int = 4096, minimum: int = 1024
) -> DataFrame:
    """Environment metrics of the speech of every recording; too little speech gives zeros."""
    pieces = selected_pieces(samples, speech, chunk_len, layout)
    metrics = band_metrics(averaged_spectrum(pieces, rate, segment, minimum), rate)
    means = pieces.select(
        MEDIA, F.aggregate("mono", F.lit(0.0), lambda a, x: a + x).alias("_s"), "n"
    ).groupBy(MEDIA).agg((F.sum("_s") / F.sum("n")).alias("dc_offset"))
    everyone = samples.select(MEDIA).distinct()
    return (
        everyone.join(metrics, MEDIA, "left")
        .join(means, MEDIA, "left")
        .na.fill({"subbass_ratio": 0.0, "hum_excess_db": 0.0, "dc_offset": 0.0})
    )
