"""Pluggable frame scorers: samples of a chunk to one score per frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MEDIA = "media_id"
Scorer = Callable[[np.ndarray], np.ndarray]


def energy_scorer(frame: int, centre_db: float, slope_db: float) -> Scorer:
    """Logistic of the frame level; stands in where no model is installed."""

    def score(samples: np.ndarray) -> np.ndarray:
        count = -(-len(samples) // frame)
        padded = np.zeros(count * frame)
        padded[: len(samples)] = samples
        power = np.square(padded.reshape(count, frame)).mean(axis=1)
        level = 20 * np.log10(np.sqrt(power + 1e-12))
        return 1 / (1 + np.exp(-(level - centre_db) / slope_db))

    return score


def scorer_column(scorer: Scorer, samples: Column) -> Column:
    """Wrap a scorer as an Arrow function of an array column."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: scorer(np.asarray(c, dtype=np.float64)))

    return scored(samples)


def score_frames(samples: DataFrame, scorer: Scorer, frame: int) -> DataFrame:
    """Frame scores of the mix of both channels, or of the one there is. Chunks must hold whole frames, except the last."""
    mix = F.zip_with(F.coalesce("ch0", "ch1"), F.coalesce("ch1", "ch0"), lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    scored = samples.select(MEDIA, "start_sample", scorer_column(scorer, mix).alias("_p"))
    return scored.select(MEDIA, "start_sample", F.posexplode("_p").alias("_k", "prob")).select(
        MEDIA, (F.col("start_sample") / frame + F.col("_k")).cast("bigint").alias("frame_idx"), "prob"
    )
