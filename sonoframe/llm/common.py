"""What the training-data operators share: tables, settled intermediates, registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.session import checkpoint_root

Query = Callable[[SparkSession, str], DataFrame]

#: Rows up to which a small side is sent to every executor; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the checkpoint folder that every executor reaches."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables settled inside each open scratch(), with their folders.
_scratch: list[list[tuple[DataFrame, str]]] = []


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate once as a table in the shared folder and read it back.

    Later references neither recompute it nor depend on executors that may be lost.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    df.write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    if _scratch:
        _scratch[-1].append((written, folder))
    return written


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are removed at the end, but for those given to the function that this yields."""
    own: list[tuple[DataFrame, str]] = []
    _scratch.append(own)

    def keep(written: DataFrame) -> DataFrame:
        place = next(k for k, (frame, _) in enumerate(own) if frame is written)
        moved = own.pop(place)
        if len(_scratch) > 1:
            _scratch[-2].append(moved)
        return written

    try:
        yield keep
    finally:
        _scratch.pop()
        for _, folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if a count shows at most `rows` rows; otherwise the frame as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
