"""Exact order statistics without collecting a group.

Values collapse to (value, count) before the shuffle; a running count over the values gives every rank.
The definitions differ on purpose and must not be unified.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.scan import Layout, key_total, running, running_sum, settle


def _ranks(definition: str, n: Column) -> list[tuple[Column, Column]]:
    """Zero-based ranks and their weights for one definition."""
    one = F.lit(1.0)
    if definition == "max":
        return [(n - 1, one)]
    if definition == "median":
        return [(F.floor((n - 1) / 2), F.lit(0.5)), (F.floor(n / 2), F.lit(0.5))]
    if definition == "upper_median":
        return [(F.floor(n / 2), one)]
    name, _, text = definition.rpartition("_")
    p = float(text)
    if name == "linear":
        place = (n - 1) * F.lit(p)
        low = F.floor(place)
        return [(low, one - (place - low)), (F.least(n - 1, low + 1), place - low)]
    if name == "nearest":
        return [(F.greatest(F.lit(0), F.ceil(n * F.lit(p)) - 1), one)]
    if name == "rounded":
        return [(F.least(n - 1, F.bround((n - 1) * F.lit(p))), one)]
    raise ValueError(f"unknown order statistic {definition!r}")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    layout: Layout,
    picks: Mapping[str, str],
    count: str = "n",
    weight: str | None = None,
) -> DataFrame:
    """One row per key; ``weight`` names an integer column when a row stands for several equal values.

    ``picks`` maps output names to ``max``, ``median`` (averaging),
    ``upper_median``, ``linear_<p>``, ``nearest_<p>`` (ceil(p*n)) or ``rounded_<p>``
    (half-even (n-1)*p)."""
    keys = list(keys)
    copies = F.count("*") if weight is None else F.sum(weight)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(copies.alias("_c"))
    counted = settle(counted, layout)
    placed = running(
        counted,
        keys,
        [value],
        layout,
        **{"_upto": running_sum(F.col("_c")), count: key_total(F.col("_c"))},
    )
    n = F.col(count)
    before = F.col("_upto") - F.col("_c")
    outputs = []
    for name, definition in picks.items():
        parts = []
        for rank, share in _ranks(definition, n):
            here = (rank >= before) & (rank < F.col("_upto"))
            parts.append(F.max(F.when(here, F.col(value) * share)))
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        outputs.append(total.alias(name))
    return placed.groupBy(*keys, count).agg(*outputs)


def delta_summary(df: DataFrame, keys: Sequence[str], value: str, layout: Layout) -> DataFrame:
    """Count, mean, upper median, capped rounded p95 and maximum, at four digits."""
    ranked = order_statistics(
        df, keys, value, layout, {"median": "upper_median", "p95": "rounded_0.95", "max": "max"}, "count"
    )
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return ranked.join(means, list(keys)).select(
        *keys, "count", *[F.bround(c, 4).alias(c) for c in ("mean", "median", "p95", "max")]
    )
