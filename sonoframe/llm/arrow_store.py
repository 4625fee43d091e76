"""Token ids as Arrow stream files of fixed-size-list batches.

Documents are ranged by doc_id over tasks; each task streams its ids into one file of equal-length sequences with a
mask, and a second file with one row per document. Every batch but a file's last has the same number of rows and the
last sequence alone is padded, so a memory map gives any sequence, or any document, without copying or decoding.
Files are written under a name of their own attempt and renamed, so a task that runs again leaves the same files.

Defined results: a null or empty text is its end id alone; documents with one doc_id come in the order of a hash of
their text, then the text; a null doc_id comes first; repeated rows are documents of their own; no rows give no files;
other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import partitions, settle
from sonoframe.llm.encoders import encoded_rows

LENGTH, BATCH_ROWS, END_ID = 2048, 64, 1
#: Ids below 65,536 are stored in 16 bits.
NARROW = 1 << 16
MANIFEST = "part long, n_docs long, n_tokens long"


def _place(folder: str):
    """File system and path of a folder named by a URI or a plain path."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _names(root: str, part: int) -> tuple[str, str]:
    return f"{root}/part-{part:06d}.arrow", f"{root}/part-{part:06d}.docs.arrow"


def sequence_schema(narrow: bool, length: int = LENGTH) -> pa.Schema:
    return pa.schema(
        [
            ("input_ids", pa.list_(pa.field("item", pa.uint16() if narrow else pa.uint32(), False), length)),
            ("mask", pa.list_(pa.field("item", pa.bool_(), False), length)),
        ]
    )


def _batch(ids: np.ndarray, schema: pa.Schema, length: int) -> pa.RecordBatch:
    rows = -(-len(ids) // length)
    padded = np.zeros(rows * length, schema[0].type.value_type.to_pandas_dtype())
    padded[: len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    lists = [
        pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((padded, mask), schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(lists, schema=schema)


def _write_worker(folder: str, path: str, end_id: int, narrow: bool, length: int):
    schema = sequence_schema(narrow, length)
    doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    step = BATCH_ROWS * length

    def run(batches):
        part = TaskContext.get().partitionId()
        filesystem, root = _place(folder)
        filesystem.create_dir(root, recursive=True)
        names = _names(root, part)
        drafts = [f"{root}/.{uuid.uuid4().hex}" for _ in names]
        total = n_docs = 0
        with (
            filesystem.open_output_stream(drafts[0]) as body,
            filesystem.open_output_stream(drafts[1]) as index,
            pa.ipc.new_stream(body, schema) as sequences,
            pa.ipc.new_stream(index, doc_schema) as docs,
        ):
            held, rows = bytearray(), []

            def put_docs():
                docs.write_batch(
                    pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=doc_schema)
                )
                rows.clear()

            for doc_id, ids in encoded_rows(batches, path, end_id):
                rows.append((doc_id, total, len(ids) // 4))
                total += len(ids) // 4
                n_docs += 1
                held += ids
                if len(held) >= 4 * step:
                    whole = len(held) // (4 * step) * step
                    values = np.frombuffer(bytes(held[: 4 * whole]), "<u4")
                    del held[: 4 * whole]
                    for at in range(0, whole, step):
                        sequences.write_batch(_batch(values[at : at + step], schema, length))
                if len(rows) >= 5000:
                    put_docs()
            if held:
                sequences.write_batch(_batch(np.frombuffer(bytes(held), "<u4"), schema, length))
            if rows:
                put_docs()
        for draft, name in zip(drafts, names, strict=True):
            if n_docs:
                filesystem.move(draft, name)
            else:
                filesystem.delete_file(draft)
        if n_docs:
            row = zip(MANIFEST.split(", "), (part, n_docs, total), strict=True)
            yield pa.RecordBatch.from_pydict({k.split()[0]: pa.array([v], pa.int64()) for k, v in row})

    return run


def write_store(
    docs: DataFrame, folder: str, path: str, vocabulary: int, end_id: int = END_ID, length: int = LENGTH, files: int | None = None
) -> DataFrame:
    """Write the files; returns the manifest (part, n_docs, n_tokens, first_token), one row per file.

    `folder` must be one that every executor reaches; `files` should grow with the input, about 100 MB of text each.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(files or partitions(spark), *order)
        .sortWithinPartitions(*order, F.col("text"))
    )
    writer = _write_worker(folder, path, end_id, max(vocabulary, end_id + 1) <= NARROW, length)
    manifest = settle(ranged.mapInArrow(writer, MANIFEST), "store-manifest")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Sequences:
    """Zero-copy access to one file: rows of ids and masks, and runs of ids across rows."""

    def __init__(self, filesystem, name: str) -> None:
        local = isinstance(filesystem, pafs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else filesystem.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema[0].type.list_size
        self.rows = self.batches[0].num_rows
        self.flat = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def __getitem__(self, row: int):
        batch = self.batches[row // self.rows]
        return batch.column(0)[row % self.rows].values, batch.column(1)[row % self.rows].values

    def ids(self, start: int, count: int):
        """Views that together hold ids [start, start + count)."""
        step = self.rows * self.length
        while count > 0:
            view = self.flat[start // step][start % step : start % step + count]
            yield view
            start, count = start + len(view), count - len(view)


def _read_worker(folder: str):
    def run(batches):
        filesystem, root = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                body, index = _names(root, row["part"])
                sequences = Sequences(filesystem, body)
                with filesystem.open_input_stream(index) as source:
                    for docs in pa.ipc.open_stream(source):
                        starts, counts = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                        sums = []
                        for start, count in zip(starts, counts, strict=True):
                            crc = 0
                            for view in sequences.ids(start, count):
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": docs.column(0),
                                "start": pa.array([row["first_token"] + s for s in starts], pa.int64()),
                                "n_tokens": docs.column(2),
                                "ids_crc32": pa.array(sums, pa.int64()),
                            }
                        )

    return run


def read_store(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spread = manifest.select("part", "first_token").repartition(partitions(spark))
    return spread.mapInArrow(_read_worker(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
