"""Regions from an arriving frame stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sonoframe.operators.regions import RegionPolicy

MEDIA = "media_id"
OUTPUT = f"{MEDIA} bigint, start bigint, end bigint"
# State values that mean "none yet".
NONE = -1


class RegionBuilder(StatefulProcessor):
    """Keeps one open region per recording: its start, the first low frame after the last high one,
    and the last frame seen.

    Frames of a recording arrive in order across micro-batches; a frame before the last one seen is late and
    dropped. Several scores at one frame are all taken, the lower first, so their order of arrival doesn't matter. When no frame has come for ``idle_ms`` of event time the signal has ended and
    an open region closes there.
    """

    def __init__(self, policy: RegionPolicy, idle_ms: int):
        self.policy, self.idle_ms = policy, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, low bigint, seen bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["frame_idx", "prob"])
        start, low, seen, timer = self.open.get() if self.open.exists() else (NONE, NONE, NONE, NONE)
        policy, found = self.policy, []
        for index, prob in zip(frames["frame_idx"].tolist(), frames["prob"].tolist()):
            if index < seen:
                continue
            seen = index
            at = index * policy.frame
            if prob >= policy.on:
                start, low = (at if start == NONE else start), NONE
            elif start != NONE and prob < policy.off:
                low = at if low == NONE else low
                if at - low >= policy.min_silence:
                    found.append((start, low))
                    start, low = NONE, NONE
        if timer != NONE:
            self.handle.deleteTimer(timer)
        timer = int(frames["ts"].max().timestamp() * 1000) + self.idle_ms
        self.handle.registerTimer(timer)
        self.open.update((start, low, seen, timer))
        yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.open.exists():
            start, _, seen, _ = self.open.get()
            if start != NONE:
                found.append((start, (seen + 1) * self.policy.frame))
            self.open.clear()
        yield self._frame(key, found)

    def _frame(self, key, found) -> pd.DataFrame:
        rows = [(key[0], s, e) for s, e in found if e - s >= self.policy.min_speech]
        return pd.DataFrame(
            {
                MEDIA: pd.Series([r[0] for r in rows], dtype="int64"),
                "start": pd.Series([r[1] for r in rows], dtype="int64"),
                "end": pd.Series([r[2] for r in rows], dtype="int64"),
            }
        )

    def close(self) -> None:
        pass


def stream_regions(frames: DataFrame, policy: RegionPolicy, delay: str, idle_ms: int) -> DataFrame:
    """Unpadded regions of a streaming ``(media_id, frame_idx, prob, ts)`` DataFrame, as they close.

    Needs the RocksDB state store provider.
    """
    return (
        frames.withWatermark("ts", delay)
        .groupBy(MEDIA)
        .transformWithStateInPandas(
            statefulProcessor=RegionBuilder(policy, idle_ms),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
