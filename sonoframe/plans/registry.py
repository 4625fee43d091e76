"""Named queries over the driver tables, each with an independent SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sonoframe.session import tune

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    survey: str


ENTRIES: dict[str, Entry] = {}


def query(name: str, survey: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")

        @wraps(run)
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return run(spark, sf_dir)

        ENTRIES[name] = Entry(tuned, sql, survey)
        return run

    return register
