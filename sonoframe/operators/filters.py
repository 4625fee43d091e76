"""Recursive filters over chunked signals.

A recursive filter is linear, so a chunk can be filtered from rest and corrected afterwards with the
state it should have started from. Chunks are filtered independently. What a chunk does to a state is an affine map,
its number of samples and its end state from rest; maps of neighbours compose to one, so the incoming states are a
prefix over maps, taken in blocks of a fixed number of chunks, then over the blocks, and so on. The exact incoming
state is joined back to every chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.session import cut

MEDIA = "media_id"
BLOCK = 64
#: Maps that one task composes in order.
FAN = 1024

Section = tuple[tuple[float, float, float], tuple[float, float]]


def highpass(cutoff: float, rate: float) -> Section:
    """Second-order maximally flat high-pass."""
    k = math.tan(math.pi * cutoff / rate)
    scale = 1.0 / (1.0 + math.sqrt(2.0) * k + k * k)
    return (scale, -2.0 * scale, scale), (
        2.0 * (k * k - 1.0) * scale,
        (1.0 - math.sqrt(2.0) * k + k * k) * scale,
    )


def notch(frequency: float, rate: float, quality: float = 35.0) -> Section:
    omega = 2.0 * math.pi * frequency / rate
    gain = 1.0 / (1.0 + math.tan(omega / quality / 2.0))
    turn = -2.0 * math.cos(omega) * gain
    return (gain, turn, gain), (turn, 2.0 * gain - 1.0)


def peaking(gain_db: float, centre: float, quality: float, rate: float) -> Section:
    amplitude = 10.0 ** (gain_db / 40.0)
    omega = 2.0 * math.pi * centre / rate
    alpha = math.sin(omega) / (2.0 * quality)
    a0 = 1.0 + alpha / amplitude
    turn = -2.0 * math.cos(omega) / a0
    return ((1.0 + alpha * amplitude) / a0, turn, (1.0 - alpha * amplitude) / a0), (
        turn,
        (1.0 - alpha / amplitude) / a0,
    )


def weighting(rate: float) -> list[Section]:
    """The two-stage loudness weighting (shelf, then high-pass) for any sample rate."""
    # Analogue parameters of the published weighting curve.
    gain, quality, centre = 3.999843853973347, 0.7071752369554196, 1681.974450955533
    k = math.tan(math.pi * centre / rate)
    high = 10.0 ** (gain / 20.0)
    band = high**0.4996667741545416
    a0 = 1.0 + k / quality + k * k
    shelf = (
        (
            (high + band * k / quality + k * k) / a0,
            2.0 * (k * k - high) / a0,
            (high - band * k / quality + k * k) / a0,
        ),
        (2.0 * (k * k - 1.0) / a0, (1.0 - k / quality + k * k) / a0),
    )
    quality, centre = 0.5003270373238773, 38.13547087602444
    k = math.tan(math.pi * centre / rate)
    a0 = 1.0 + k / quality + k * k
    return [shelf, ((1.0, -2.0, 1.0), (2.0 * (k * k - 1.0) / a0, (1.0 - k / quality + k * k) / a0))]


class Cascade:
    """State-space form of sections in series: x' = A x + B u, y = C x + D u."""

    def __init__(self, sections: Sequence[Section]):
        a, b, c, d = np.zeros((0, 0)), np.zeros((0, 1)), np.zeros((1, 0)), 1.0
        for (b0, b1, b2), (a1, a2) in sections:
            sa = np.array([[-a1, 1.0], [-a2, 0.0]])
            sb = np.array([[b1 - a1 * b0], [b2 - a2 * b0]])
            sc = np.array([[1.0, 0.0]])
            n = a.shape[0]
            a = np.block([[a, np.zeros((n, 2))], [sb @ c, sa]])
            b = np.vstack([b, sb * d])
            c = np.hstack([b0 * c, sc])
            d = b0 * d
        self.a, self.b, self.c, self.d = a, b, c, d
        self.order = a.shape[0]
        powers = [np.eye(self.order)]
        for _ in range(BLOCK):
            powers.append(powers[-1] @ a)
        self.powers = powers
        # Response of a block to its own samples, to its start state, and of its end state to both.
        impulse = [d] + [float((c @ powers[k] @ b).item()) for k in range(BLOCK - 1)]
        self.own = np.zeros((BLOCK, BLOCK))
        for i in range(BLOCK):
            self.own[i, : i + 1] = impulse[i::-1] if i else impulse[:1]
        self.from_state = np.vstack([c @ powers[k] for k in range(BLOCK)])
        self.to_state = np.hstack([powers[BLOCK - 1 - k] @ b for k in range(BLOCK)])

    def power(self, steps: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, steps)

    def run(self, signal: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter from ``state``; returns the output and the end state."""
        signal = np.asarray(signal, dtype=np.float64)
        whole = len(signal) // BLOCK
        blocks = signal[: whole * BLOCK].reshape(whole, BLOCK)
        driven = blocks @ self.to_state.T
        starts = np.empty((whole, self.order))
        for index in range(whole):
            starts[index] = state
            state = self.powers[BLOCK] @ state + driven[index]
        out = [(blocks @ self.own.T + starts @ self.from_state.T).reshape(-1)]
        rest = signal[whole * BLOCK :]
        if len(rest):
            n = len(rest)
            out.append(self.own[:n, :n] @ rest + self.from_state[:n] @ state)
            ended = self.powers[n] @ state
            for k in range(n):
                ended = ended + self.powers[n - 1 - k] @ self.b[:, 0] * rest[k]
            state = ended
        return np.concatenate(out), state


MAP = f"{MEDIA} bigint, position bigint, n bigint, e0 array<double>, e1 array<double>"
STATE = f"{MEDIA} bigint, position bigint, s0 array<double>, s1 array<double>"


def incoming_states(maps: DataFrame, cascade: Cascade, fan: int = FAN) -> DataFrame:
    """The state before each map (media_id, position, n samples, end states from rest) of a recording, from rest.

    A task sees at most ``fan`` maps of a recording; the number of levels grows with the logarithm of its length.
    """
    zero = np.zeros(cascade.order)

    def advance(powers: dict[int, np.ndarray], state: np.ndarray, n: int, end: Sequence[float] | None) -> np.ndarray:
        if n not in powers:
            powers[n] = cascade.power(n)
        return powers[n] @ state + (zero if end is None else np.asarray(end))

    def composed(key, rows):
        powers: dict[int, np.ndarray] = {}
        states = [zero, zero]
        for n, *ends in rows.sort_values("position")[["n", "e0", "e1"]].itertuples(index=False):
            states = [advance(powers, s, n, e) for s, e in zip(states, ends)]
        return pd.DataFrame([(*key, int(rows["n"].sum()), *(s.tolist() for s in states))], columns=[MEDIA, "position", "n", "e0", "e1"])

    def spread_out(key, rows):
        powers: dict[int, np.ndarray] = {}
        rows, out = rows.sort_values("position"), []
        states = [np.asarray(rows[s].iloc[0]) for s in ("s0", "s1")]
        for position, n, *ends in rows[["position", "n", "e0", "e1"]].itertuples(index=False):
            out.append((key[0], position, *(s.tolist() for s in states)))
            states = [advance(powers, s, n, e) for s, e in zip(states, ends)]
        return pd.DataFrame(out, columns=[MEDIA, "position", "s0", "s1"])

    block = F.floor(F.col("position") / fan).cast("bigint").alias("_block")
    last = maps.agg(F.max("position")).first()[0] or 0
    rest = F.array(*[F.lit(0.0)] * cascade.order)
    if last < fan:
        started = maps.withColumns({"_block": F.lit(0).cast("bigint"), "s0": rest, "s1": rest})
    else:
        blocks = cut(maps.groupBy(MEDIA, block).applyInPandas(composed, MAP))
        before = incoming_states(blocks, cascade, fan).withColumnRenamed("position", "_block")
        started = maps.withColumn("_block", block).join(before, [MEDIA, "_block"])
    return started.groupBy(MEDIA, "_block").applyInPandas(spread_out, STATE)


def filter_signal(samples: DataFrame, sections: Sequence[Section], fan: int = FAN) -> DataFrame:
    """Filter both channels of every recording from rest, exactly, chunk-parallel."""
    cascade = Cascade(sections)
    zero = np.zeros(cascade.order)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for media, chunk, *channels in zip(batch[MEDIA], batch["chunk_id"], batch["ch0"], batch["ch1"]):
                states = [None if ch is None else cascade.run(ch, zero)[1].tolist() for ch in channels]
                rows.append((media, chunk, len(channels[0]), *states))
            yield pd.DataFrame(rows, columns=[MEDIA, "position", "n", "e0", "e1"])

    maps = cut(samples.select(MEDIA, "chunk_id", "ch0", "ch1").mapInPandas(ends, MAP))
    incoming = incoming_states(maps, cascade, fan).withColumnRenamed("position", "chunk_id")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[MEDIA, "chunk_id", "start_sample"]].copy()
            for channel, state in (("ch0", "s0"), ("ch1", "s1")):
                out[channel] = [
                    None if x is None else cascade.run(x, np.asarray(s))[0].astype(np.float32)
                    for x, s in zip(batch[channel], batch[state])
                ]
            yield out

    schema = f"{MEDIA} bigint, chunk_id bigint, start_sample bigint, ch0 array<float>, ch1 array<float>"
    return samples.join(incoming, [MEDIA, "chunk_id"]).mapInPandas(apply, schema)


def blend_signals(
    original: DataFrame,
    processed: DataFrame,
    intervals: DataFrame,
    fade: int,
    chunk_len: int,
    outside: bool = False,
) -> DataFrame:
    """Processed signal in faded intervals ``(media_id, start, end)``, original elsewhere.

    Ramps lie inside the intervals, or ``outside`` them so that the whole interval is treated fully.
    """
    from sonoframe.functions.levels import blend, fade_inside, fade_outside
    from sonoframe.operators.levels import signal_sizes
    from sonoframe.operators.rangejoin import BUCKET, with_buckets

    margin = fade if outside else 0
    reach = intervals.select(MEDIA, "start", "end").distinct().join(signal_sizes(original), MEDIA).select(
        MEDIA,
        F.col("start").alias("s"),
        F.col("end").alias("e"),
        F.greatest(F.lit(0), F.col("start") - margin).alias("start"),
        F.least(F.col("total_samples"), F.col("end") + margin).alias("end"),
        "total_samples",
    )
    pieces = with_buckets(reach, "start", "end", chunk_len).withColumnRenamed(BUCKET, "chunk_id")
    marks = pieces.groupBy(MEDIA, "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("s", "e", "total_samples"))).alias("_marks")
    )
    other = processed.select(MEDIA, "chunk_id", F.col("ch0").alias("_p0"), F.col("ch1").alias("_p1"))
    joined = original.join(marks, [MEDIA, "chunk_id"], "left").join(other, [MEDIA, "chunk_id"])

    def mixed(channel: str, treated: str):
        def one(x, k):
            at = F.col("start_sample") + k

            def weigh(mark):
                if outside:
                    return fade_outside(at, mark["s"], mark["e"], fade, mark["total_samples"])
                return fade_inside(at, mark["s"], mark["e"], fade)

            weight = F.aggregate("_marks", F.lit(0.0), lambda m, s: F.greatest(m, weigh(s)))
            return blend(x.cast("double"), F.get(F.col(treated), k).cast("double"), weight).cast("float")

        return F.when(F.col("_marks").isNull(), F.col(channel)).otherwise(F.transform(channel, one))

    return joined.withColumns({"ch0": mixed("ch0", "_p0"), "ch1": mixed("ch1", "_p1")}).drop(
        "_marks", "_p0", "_p1"
    )
