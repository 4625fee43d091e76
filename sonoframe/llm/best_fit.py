"""Best-fit-decreasing packing of token ids into as few sequences as it can.

A document longer than the capacity is cut into pieces of the capacity, the last of which may be shorter; others stay
whole. Pieces are taken by length, longest first, and each goes into the open sequence that it fills most. The open
sequences are counted by remaining capacity, 0 to the capacity, and a segment tree over these counts finds the
tightest one that is large enough in logarithmic time.

Only lengths matter for this, and there are no more of them than the capacity. So the corpus is counted by length
first, and the tree is asked once for each run of pieces of one length that go into sequences of equal remaining
capacity; the outcome, which sequence each piece would get if they were placed one by one, is the same. The plan is a
list of runs whose size depends on the capacity and not on the corpus. Workers number their pieces of each length;
with the number of such pieces in the workers before, that gives a piece's rank among all of its length, and the run
that holds the rank gives sequence and offset. Ids never meet in one place: they are written once by the worker that
encoded them, and read by whoever wants the pieces.

Defined results: a null or empty text is its end id alone; repeated rows and rows with one or no doc_id are documents
of their own; no rows give no pieces; other columns are ignored. Very long texts become full sequences and one rest.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import settle, small
from sonoframe.llm.encoders import encoded_rows

CAPACITY, END_ID = 2048, 0
PIECE = "worker long, number long, doc_id long, piece int, start long, length int, ids binary"
#: Pieces of so many ids at most are held before they are handed on.
HELD_IDS = 1 << 20


class TightestFit:
    """Counts at remaining capacities 0..capacity, under a binary tree of sums."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, remaining: int, change: int) -> None:
        at = self.leaves + remaining
        while at:
            self.sums[at] += change
            at //= 2

    def find(self, needed: int) -> int:
        """The least remaining capacity of an open sequence with room for `needed`, or -1."""
        at = self.leaves + needed
        if self.sums[at]:
            return needed
        # Up to the first right sibling that holds anything, then down its left edge.
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset) of best fit decreasing.

    Piece `first rank + k` of a length is in sequence `first sequence + k // each`, at `offset + k % each * length`.
    """
    tree = TightestFit(capacity)
    # Open sequences of one remaining capacity, as ranges (first, how many).
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, made = [], 0

    def opened(first: int, many: int, remaining: int) -> None:
        if many and remaining:
            ranges[remaining].append((first, many))
            tree.add(remaining, many)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.find(length)
            if remaining < 0:
                remaining, each = capacity, capacity // length
                first, many = made, -(-left // each)
                made += many
            else:
                each = remaining // length
                first, many = ranges[remaining].pop()
                tree.add(remaining, -many)
            take = min(left, many * each)
            runs.append((length, rank, first, each, capacity - remaining))
            full, part = divmod(take, each)
            opened(first, full, remaining - each * length)
            opened(first + full, int(part > 0), remaining - part * length)
            opened(first + full + (part > 0), many - full - (part > 0), remaining)
            rank, left = rank + take, left - take
    return runs


def _piece_worker(path: str, end_id: int, capacity: int):
    schema = pa.schema(
        [
            ("worker", pa.int64()),
            ("number", pa.int64()),
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int32()),
            ("ids", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        done: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for doc_id, ids in encoded_rows(batches, path, end_id):
            for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + capacity)]
                length = len(part) // 4
                done.append((worker, seen[length], doc_id, piece, start, length, part))
                seen[length] += 1
                held += length
                if held >= HELD_IDS:
                    yield flush()
                    held = 0
        if done:
            yield flush()

    return run


def _placer(runs: list[tuple[int, int, int, int, int]]):
    """Sequence and offset of pieces given by length and rank."""
    table = np.array(runs, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(lengths), np.int64)
        for value in np.unique(lengths):
            low, high = np.searchsorted(table[:, 0], (value, value + 1))
            here = lengths == value
            at[here] = low + np.searchsorted(table[low:high, 1], ranks[here], "right") - 1
        _, first_rank, first, each, offset = table[at].T
        k = ranks - first_rank
        return pd.DataFrame({"sequence_id": first + k // each, "offset": offset + k % each * lengths})

    return place


def best_fit_pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids, sequence_id, offset); a sequence is its pieces by offset.

    ids are little-endian unsigned 32-bit. Sequence ids run from 0 without gaps.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = settle(rows.mapInArrow(_piece_worker(path, end_id, capacity), PIECE), "best-fit-pieces")
    per_worker = settle(pieces.groupBy("worker", "length").agg(F.count(F.lit(1)).alias("many")), "best-fit-counts")
    # One row per length, so at most as many as the capacity.
    counts = {r["length"]: r["many"] for r in per_worker.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    place = _placer(plan_runs(counts, capacity))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_worker.select("worker", "length", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(small(bases), ["worker", "length"])
    placed = ranked.withColumn("place", place("length", F.col("base") + F.col("number")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids", "place.sequence_id", "place.offset")
