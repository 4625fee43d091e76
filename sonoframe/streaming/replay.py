"""Run a streaming DataFrame over everything available and read its output table back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sonoframe.session import checkpoint_root


def read_growing(
    spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """Stream of the files called ``name`` in a folder.

    ``files_per_trigger`` bounds a micro-batch, and with it what one key can bring at a time.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder)


def _run(stream: DataFrame, base: str) -> None:
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


def _new_base(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Process all available input into a Parquet table under the shared checkpoint folder.

    What is still open at the last watermark is not written; ``drain_whole`` closes it.
    """
    spark, base = stream.sparkSession, _new_base(stream.sparkSession)
    _run(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def drain_whole(source: DataFrame, build: Callable[[DataFrame], DataFrame], closing: DataFrame) -> DataFrame:
    """Like ``drain`` of ``build(source)``, with everything closed at the end of the input.

    ``closing`` is one row of the source's columns under a key of its own, later than all the watermark's delays and
    gaps reach. It arrives in a batch after the rest; what it opens itself stays open and is not written.
    """
    spark, base = source.sparkSession, _new_base(source.sparkSession)
    closing = closing.select(*(closing[c].cast(t) for c, t in source.dtypes))
    closing.where("false").write.parquet(f"{base}/closing")
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{base}/closing")))
    _run(stream, base)
    closing.write.mode("append").parquet(f"{base}/closing")
    _run(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
