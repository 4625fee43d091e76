"""Hashed word shingles of texts, and how frequent they are in a corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose hash a task keeps, some 25 MB; they are dropped at its end. Longer ones are never kept.
KEPT_WORDS, KEPT_BYTES = 150_000, 32
#: Counters of the frequency table, parts it is summed in, and parts added up by one task at a time.
COUNTERS, SLICES, FAN_IN = 1 << 22, 64, 64
#: Classes of frequency; the first is for everything not clearly above the mean.
CLASSES = 16

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS and len(word) <= KEPT_BYTES:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


@contextmanager
def kept_words() -> Iterator[None]:
    """Around the work of a task: drops at its end what shingle_hashes keeps."""
    try:
        yield
    finally:
        _word_hashes().clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of all shingles of a text in order; fewer words than `size` are one shingle, none are none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    found = np.full(count, width, np.uint64) * _GOLDEN
    for j in range(width):
        found = _mixed(found ^ each[j : j + count]) + _GOLDEN
    return found


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _count_worker(size: int):
    def run(batches):
        # A task's shingles are far fewer than 2 ** 32.
        counts = np.zeros(COUNTERS, np.uint32)
        held: list[np.ndarray] = []
        waiting = 0

        def add():
            nonlocal waiting
            if held:
                slots, many = np.unique((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.uint32), return_counts=True)
                counts[slots] += many.astype(np.uint32)
            held.clear()
            waiting = 0

        with kept_words():
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(shingle_hashes(text, size))
                    waiting += len(held[-1])
                    if waiting > 1_000_000:
                        add()
        add()
        if not counts.any():
            return
        parts = [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in counts.reshape(SLICES, -1)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {
                "task": pa.array([task] * SLICES, pa.int64()),
                "slice": pa.array(range(SLICES), pa.int64()),
                "counts": pa.array(parts, pa.binary()),
            }
        )

    return run


def _added(key, parts):
    total = sum(np.frombuffer(zlib.decompress(p), np.int64) for p in parts["counts"])
    return pd.DataFrame({"task": [key[1]], "slice": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_classes(docs: DataFrame, size: int) -> np.ndarray:
    """A class per counter, over all shingles of all texts: 0 for common counts, higher for far more frequent ones.

    The table has a fixed size, whatever the corpus holds. It only sets an order of shingles, so counters that
    several shingles share cost time and never results.
    """
    schema = "task long, slice long, counts binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_count_worker(size), schema)
    tasks = parts.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN_IN)
        group = F.floor(F.col("task") / FAN_IN).alias("task")
        parts = parts.groupBy("slice", group).applyInPandas(_added, schema)
        if tasks <= 1:
            break
    # SLICES rows of fixed size.
    rows = parts.collect()
    counts = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for row in rows:
        counts[row["slice"]] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    counts = counts.ravel()
    mean = counts.mean()
    base = mean + 3 * np.sqrt(mean) + 3
    return np.minimum(CLASSES - 1, np.ceil(np.log2(np.maximum(counts / base, 0.5) + 1e-9)) + 1).clip(0).astype(np.uint8)


def ordered_keys(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Non-negative 63-bit keys whose order is (class, hash): rarer classes first."""
    shift = np.uint64(59)
    return (classes[(found & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << shift) | (found >> np.uint64(5))
