"""Harmonic packing of token ids into sequences of equal capacity.

A document's ids are cut greedily into pieces of reciprocal-capacity sizes: capacity // k for k up to CLASSES, and a
rest below the smallest of these as it is. Pieces of one size form a class whose bins hold a fixed number of them,
so each worker fills its bins alone, in one pass, holding less than one bin per class. What a worker has left in
unfilled bins is bounded by its classes, not by its input; these pieces are laid end to end over all workers and cut
at the capacity. Padding is capacity % k in a full bin, and the end of one sequence of the whole corpus.

Defined results: a null or empty text is its end id alone; repeated rows and rows with one or no doc_id are
documents of their own; no rows give no pieces; other columns are ignored. Very long texts become whole sequences.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import settle
from sonoframe.llm.encoders import encoded_rows

CAPACITY, CLASSES, END_ID = 4096, 64, 2
PIECE = (
    "worker long, slot long, sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"
)


def class_sizes(capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Piece sizes, largest first, without repeats."""
    return sorted({capacity // k for k in range(1, min(classes, capacity) + 1)}, reverse=True)


def cuts(tokens: int, sizes: list[int]) -> list[int]:
    """Greedy lengths of the pieces of a document."""
    out: list[int] = []
    for size in sizes:
        times, tokens = divmod(tokens, size)
        out += [size] * times
    return out + [tokens] if tokens else out


def _pack_worker(path: str, end_id: int, capacity: int, classes: int):
    sizes = class_sizes(capacity, classes)

    def run(batches):
        worker = TaskContext.get().partitionId()
        open_bins: dict[int, list[tuple]] = defaultdict(list)
        done: list[tuple] = []
        filled = 0

        def flush():
            schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in PIECE.split(", "))])
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for doc_id, ids in encoded_rows(batches, path, end_id):
            tokens, start = len(ids) // 4, 0
            for length in cuts(tokens, sizes):
                piece = (doc_id, start, length, tokens, ids[4 * start : 4 * (start + length)])
                start += length
                if length * 2 > capacity:
                    full = [piece]
                else:
                    full = open_bins[length]
                    full.append(piece)
                    if len(full) < capacity // length:
                        continue
                    open_bins[length] = []
                sequence = (worker + 1 << 32) + filled
                filled += 1
                done += [(worker, None, sequence, k * length, *p) for k, p in enumerate(full)]
            if len(done) >= 2000:
                yield flush()
        slot = 0
        for length in sorted(open_bins, reverse=True):
            for piece in open_bins[length]:
                done.append((worker, slot, None, None, *piece))
                slot += 1
        if done:
            yield flush()

    return run


def pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """Pieces (sequence_id, offset, doc_id, start, length, doc_tokens, ids); a sequence is its pieces by offset.

    ids are little-endian unsigned 32-bit. Sequence ids are unique, not dense.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = settle(rows.mapInArrow(_pack_worker(path, end_id, capacity, classes), PIECE), "packing")
    full = placed.where(F.col("sequence_id").isNotNull())
    left = placed.where(F.col("sequence_id").isNull())
    # One row per worker here, and a bounded number of pieces per worker below.
    before = Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        left.groupBy("worker")
        .agg(F.sum("length").alias("tokens"))
        .select("worker", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("worker").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        left.withColumn("at", F.coalesce(F.sum("length").over(within), F.lit(0)))
        .join(bases, "worker")
        .withColumn("at", F.col("at") + F.col("base"))
    )
    cap = F.lit(capacity).cast("long")
    sequence = F.explode(
        F.sequence(F.floor(F.col("at") / cap), F.floor((F.col("at") + F.col("length") - 1) / cap))
    )
    part = laid.withColumn("sequence_id", sequence).withColumns(
        {
            "from": F.greatest(F.col("sequence_id") * cap - F.col("at"), F.lit(0)),
            "to": F.least((F.col("sequence_id") + 1) * cap - F.col("at"), F.col("length")),
        }
    )
    size = F.col("to") - F.col("from")
    rest = part.select(
        "sequence_id",
        (F.col("at") + F.col("from") - F.col("sequence_id") * cap).alias("offset"),
        "doc_id",
        (F.col("start") + F.col("from")).alias("start"),
        size.alias("length"),
        "doc_tokens",
        F.substring(F.col("ids"), (4 * F.col("from") + 1).cast("int"), (4 * size).cast("int")).alias("ids"),
    )
    return full.select(*rest.columns).unionByName(rest)
