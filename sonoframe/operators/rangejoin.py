"""Interval joins as equi-joins on time buckets with an exact residual predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(position: Column, width: int | float) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def with_buckets(df: DataFrame, start: str, end: str, width: int | float) -> DataFrame:
    """One row per bucket that the half-open ``[start, end)`` touches; empty intervals keep one."""
    first = bucket_of(F.col(start), width)
    last = F.greatest(first, F.ceil(F.col(end) / F.lit(width)).cast("bigint") - 1)
    return df.withColumn(BUCKET, F.explode(F.sequence(first, last)))


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_right_{k}" for k in [*keys, BUCKET]})


def _same(keys: Sequence[str]) -> Column:
    condition = F.col(BUCKET) == F.col(f"_right_{BUCKET}")
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_right_{key}"))
    return condition


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: int | float,
    how: str = "inner",
) -> DataFrame:
    """Join every point to the half-open intervals that hold it. Column names must not clash."""
    left = points.withColumn(BUCKET, bucket_of(F.col(at), width))
    right = _renamed(with_buckets(intervals, start, end, width), keys)
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    joined = left.join(right, _same(keys) & inside, how)
    return joined.drop(BUCKET, *[f"_right_{k}" for k in [*keys, BUCKET]])


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    width: int | float,
) -> DataFrame:
    """Every truly overlapping pair once: it is emitted in the bucket holding the later start."""
    (ls, le), (rs, re_) = left_bounds, right_bounds
    a = with_buckets(left, ls, le, width)
    b = _renamed(with_buckets(right, rs, re_, width), keys)
    overlap = (
        (F.col(ls) < F.col(re_))
        & (F.col(le) > F.col(rs))
        & (F.col(BUCKET) == bucket_of(F.greatest(F.col(ls), F.col(rs)), width))
    )
    joined = a.join(b, _same(keys) & overlap)
    return joined.drop(BUCKET, *[f"_right_{k}" for k in [*keys, BUCKET]])
