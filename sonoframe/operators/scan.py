"""Ordered running computations that survive one recording holding most of the rows.

A plain ``Window.partitionBy("media_id")`` puts a whole recording in one task. Here the recording is
cut into chunks of bounded size along its own order column; each chunk is scanned on its own, one
summary row per chunk is carried forward (or backward), and the carry is joined back. Only the small
summary ever goes through a per-recording window. When a measurement shows that every recording fits
one window group, the same call plans the single window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.session import cut

CHUNK = "_chunk"
TARGET_ROWS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """How an ordered scan is split: ``span`` order units per chunk, or None for one window per key."""

    span: int | None = None

    def chunk(self, position: Column) -> Column:
        return F.floor(position / F.lit(self.span)).cast("bigint")


SINGLE = Layout(None)


def settle(df: DataFrame, layout: Layout) -> DataFrame:
    """Write an intermediate that a chunked scan is about to read twice.

    A chunked scan reads its input for the rows and for the chunk summaries, so a chain of them would
    recompute its start once per branch. Single-window plans read once and stay lazy.
    """
    return df if layout.span is None else cut(df)


def measure_layout(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    bucket: int,
    rows_per_item: int = 1,
) -> Layout:
    """Pick chunk widths from the data: two map-side-combined counts, each returning one number.

    ``rows_per_item`` says how many rows of later steps one counted row stands for.
    """
    target_rows = max(1, TARGET_ROWS // rows_per_item)
    peak = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if peak <= target_rows:
        return SINGLE
    cell = F.floor(position / F.lit(bucket)).alias("_cell")
    densest = df.groupBy(*keys, cell).count().agg(F.max("count")).first()[0]
    if densest >= target_rows:
        return Layout(max(1, bucket * target_rows // densest))
    return Layout(bucket * (target_rows // densest))


def tightened(layout: Layout, factor: int) -> Layout:
    """The same chunks on an axis ``factor`` times coarser."""
    return layout if layout.span is None else Layout(max(1, layout.span // factor))


@dataclass(frozen=True)
class Running:
    """One running measure. ``kind``: sum, max, min, last, next, lag, lead, or total (of the whole key)."""

    kind: str
    column: Column
    inclusive: bool = True


def running_sum(column: Column, inclusive: bool = True) -> Running:
    return Running("sum", column, inclusive)


def running_max(column: Column, inclusive: bool = True) -> Running:
    return Running("max", column, inclusive)


def last_known(column: Column, inclusive: bool = True) -> Running:
    return Running("last", column, inclusive)


def next_known(column: Column, inclusive: bool = True) -> Running:
    return Running("next", column, inclusive)


def lag(column: Column) -> Running:
    return Running("lag", column)


def lead(column: Column) -> Running:
    return Running("lead", column)


def key_total(column: Column) -> Running:
    """Sum over the whole key on every row, without joining on the bare key."""
    return Running("total", column)


def row_index() -> Running:
    """Zero-based position within the key."""
    return Running("sum", F.lit(1).cast("bigint"), inclusive=False)


def _local(measure: Running, ascending: Window, descending: Window) -> Column:
    upto = 0 if measure.inclusive else -1
    before = ascending.rowsBetween(Window.unboundedPreceding, upto)
    if measure.kind == "total":
        whole = ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.sum(measure.column).over(whole)
    if measure.kind == "sum":
        return F.coalesce(F.sum(measure.column).over(before), F.lit(0))
    if measure.kind == "max":
        return F.max(measure.column).over(before)
    if measure.kind == "min":
        return F.min(measure.column).over(before)
    if measure.kind == "last":
        return F.last(measure.column, ignorenulls=True).over(before)
    if measure.kind == "next":
        # A reversed order keeps the growing frame linear; an unbounded-following frame is quadratic.
        after = descending.rowsBetween(Window.unboundedPreceding, upto)
        return F.last(measure.column, ignorenulls=True).over(after)
    if measure.kind == "lag":
        return F.lag(measure.column).over(ascending)
    if measure.kind == "lead":
        return F.lead(measure.column).over(ascending)
    raise ValueError(f"unknown running measure {measure.kind!r}")


def _boxed(measure: Running) -> Column:
    return F.struct(measure.column.alias("v"))


def _summary(measure: Running, order: Sequence[str]) -> Column:
    if measure.kind in ("sum", "total"):
        return F.sum(measure.column)
    if measure.kind == "max":
        return F.max(measure.column)
    if measure.kind == "min":
        return F.min(measure.column)
    at = F.struct(*order)
    if measure.kind == "lag":
        return F.max_by(_boxed(measure), at)
    if measure.kind == "lead":
        return F.min_by(_boxed(measure), at)
    known = F.when(measure.column.isNotNull(), at)
    if measure.kind == "last":
        return F.max_by(measure.column, known)
    return F.min_by(measure.column, known)


def _carry(measure: Running, summary: Column, keys: Sequence[str]) -> Column:
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    if measure.kind == "sum":
        return F.sum(summary).over(before)
    if measure.kind == "total":
        return F.sum(summary).over(Window.partitionBy(*keys))
    if measure.kind == "max":
        return F.max(summary).over(before)
    if measure.kind == "min":
        return F.min(summary).over(before)
    if measure.kind == "last":
        return F.last(summary, ignorenulls=True).over(before)
    if measure.kind == "lag":
        return F.lag(summary).over(by_chunk)
    if measure.kind == "lead":
        return F.lead(summary).over(by_chunk)
    reversed_chunks = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
    return F.last(summary, ignorenulls=True).over(
        reversed_chunks.rowsBetween(Window.unboundedPreceding, -1)
    )


def _combine(measure: Running, local: Column, carried: Column) -> Column:
    if measure.kind == "sum":
        return local + F.coalesce(carried, F.lit(0))
    if measure.kind == "total":
        return carried
    if measure.kind == "max":
        return F.greatest(local, carried)
    if measure.kind == "min":
        return F.least(local, carried)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    layout: Layout,
    **measures: Running,
) -> DataFrame:
    """Add one column per measure, computed along ``order`` within ``keys``.

    ``order[0]`` must be the numeric position the layout chunks on, and ``order`` must be unique per
    key for the result to be deterministic.
    """
    keys, order = list(keys), list(order)
    descending_order = [F.col(name).desc() for name in order]
    if layout.span is None:
        ascending = Window.partitionBy(*keys).orderBy(*order)
        descending = Window.partitionBy(*keys).orderBy(*descending_order)
        return df.withColumns({n: _local(m, ascending, descending) for n, m in measures.items()})

    chunked = df.withColumn(CHUNK, layout.chunk(F.col(order[0])))
    ascending = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    descending = Window.partitionBy(*keys, CHUNK).orderBy(*descending_order)
    boxed = {
        n: Running(m.kind, _boxed(m), m.inclusive) if m.kind in ("lag", "lead") else m
        for n, m in measures.items()
    }
    local = chunked.withColumns(
        {f"_local_{n}": _local(m, ascending, descending) for n, m in boxed.items()}
    )
    totals = chunked.groupBy(*keys, CHUNK).agg(
        *[_summary(m, order).alias(f"_total_{n}") for n, m in measures.items()]
    )
    carries = totals.select(
        *keys,
        CHUNK,
        *[_carry(m, F.col(f"_total_{n}"), keys).alias(f"_carry_{n}") for n, m in measures.items()],
    )
    joined = local.join(carries, [*keys, CHUNK], "left")
    out = []
    for name, measure in measures.items():
        value = _combine(boxed[name], F.col(f"_local_{name}"), F.col(f"_carry_{name}"))
        out.append((value["v"] if measure.kind in ("lag", "lead") else value).alias(name))
    kept = [c for c in df.columns if c not in measures]
    return joined.select(*kept, *out)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    layout: Layout,
    starts_new: Column,
    island: str = "island",
) -> DataFrame:
    """Number the groups opened by ``starts_new`` (evaluated on already-lagged columns), from 1."""
    flagged = settle(df.withColumn("_new", starts_new.cast("bigint")), layout)
    return running(flagged, keys, order, layout, **{island: running_sum(F.col("_new"))}).drop("_new")


def as_of(
    points: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    layout: Layout,
    *,
    event_at: str,
    value: str,
    alias: str,
    tie_break: Sequence[str],
    forward: bool = False,
    include_equal: bool = True,
) -> DataFrame:
    """Nearest event value at or before (``forward``: at or after) each point, without pairing rows.

    Both sides become one ordered stream, so the cost is a scan and not points x events.
    """
    event_first = include_equal != forward
    rank_point, rank_event = (1, 0) if event_first else (0, 1)
    tagged_points = points.withColumns(
        {"_at": F.col(at).cast("double"), "_rank": F.lit(rank_point), "_event": F.lit(False)}
    )
    tagged_events = events.select(
        *keys,
        F.col(event_at).cast("double").alias("_at"),
        F.col(value).alias("_value"),
        F.lit(rank_event).alias("_rank"),
        F.lit(True).alias("_event"),
    )
    merged = tagged_points.unionByName(tagged_events, allowMissingColumns=True)
    measure = (next_known if forward else last_known)(F.col("_value"))
    scanned = running(
        merged, keys, ["_at", "_rank", *tie_break, "_value"], layout, **{alias: measure}
    )
    return scanned.where(~F.col("_event")).drop("_at", "_rank", "_event", "_value")
