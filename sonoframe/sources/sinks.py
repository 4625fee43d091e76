"""Reports and signals out of Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.fingerprint import canonical
from sonoframe.session import cut
from sonoframe.sources.pcm import located


def report_json(document: str, schema: T.DataType) -> Column:
    """A struct column as canonical JSON: keys sorted, non-finite numbers dropped to null."""
    return F.to_json(canonical(F.col(document), schema), {"ignoreNullFields": "false"})


def write_reports(reports: DataFrame, key: str, document: str, path: str, replace: bool = False) -> None:
    """One JSON document per row, partitioned by a hash bucket of the key; committed all or nothing."""
    schema = reports.schema[document].dataType
    mode = "overwrite" if replace else "errorifexists"
    reports.select(
        key, report_json(document, schema).alias("report"), F.pmod(F.xxhash64(key), F.lit(64)).alias("bucket")
    ).write.mode(mode).partitionBy("bucket").parquet(path)


def write_samples(samples: DataFrame, path: str, replace: bool = False) -> None:
    """Chunked signals as Parquet, bucketed so that one long recording spreads over many files."""
    bucket = F.pmod(F.xxhash64("media_id", "chunk_id"), F.lit(64))
    mode = "overwrite" if replace else "errorifexists"
    samples.withColumn("bucket", bucket).write.mode(mode).partitionBy("bucket").parquet(path)


def write_jsonl(segments: DataFrame, path: str, replace: bool = False) -> None:
    """One segment object per line in (recording, start) order, range-partitioned over the files."""
    mode = "overwrite" if replace else "errorifexists"
    segments.orderBy("media_id", "start").write.mode(mode).json(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Files of ``(name, content)`` rows below a folder every executor reaches; returns ``(name, bytes)``, one row each.

    A file is written under a name of its own attempt and then renamed, so a task that runs again leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(content.as_buffer())
                system.move(draft, f"{root}/{name}")
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return cut(files.select("name", "content").mapInArrow(write, "name string, bytes bigint"))
