"""Digests of ordered sequences of any length, as trees of chunk digests.

Items are numbered along their key, and a fixed number of neighbours make one digest; the digests of chunks are digested
in turn until one is left. So no task joins a whole sequence into one string, equal sequences have equal trees, and
where two differ the chunks that differ can be named.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.scan import Layout, row_index, running
from sonoframe.session import cut

#: Digests that make one of the next level.
CHUNK = 4096


def chunk_digests(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Column], layout: Layout, chunk: int = CHUNK
) -> DataFrame:
    """(keys, level_idx, items, one digest per column) of every ``chunk`` neighbours."""
    named = items.select(*keys, *order, *[F.sha2(F.coalesce(c, F.lit("")), 256).alias(n) for n, c in columns.items()])
    placed = running(named, keys, order, layout, level_idx=row_index())
    return _joined(placed.withColumn("items", F.lit(1).cast("bigint")), keys, list(columns), chunk)


def _joined(level: DataFrame, keys: Sequence[str], names: Sequence[str], chunk: int) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("level_idx", *names)))
    packed = level.groupBy(*keys, F.floor(F.col("level_idx") / chunk).cast("bigint").alias("_next")).agg(
        F.sum("items").alias("items"), rows.alias("_rows")
    )
    return packed.select(
        *keys,
        F.col("_next").alias("level_idx"),
        "items",
        *[F.sha2(F.array_join(F.col(f"_rows.{n}"), ""), 256).alias(n) for n in names],
    )


def sequence_digests(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Column], layout: Layout, chunk: int = CHUNK
) -> DataFrame:
    """(keys, items, one digest per column) of each key's sequence in ``order``; a null item counts as an empty one."""
    names = list(columns)
    level = cut(chunk_digests(items, keys, order, columns, layout, chunk))
    while (level.agg(F.max("level_idx")).first()[0] or 0) > 0:
        level = cut(_joined(level, keys, names, chunk))
    return level.select(*keys, "items", *names)
