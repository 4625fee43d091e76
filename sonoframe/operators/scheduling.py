"""Work ordering and budgets expressed as plan columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.scan import Layout, row_index, running, running_sum, settle

MEDIA = "media_id"


def budgeted_batches(items: DataFrame, batch_size: int, budget: int, layout: Layout) -> DataFrame:
    """Batch by ascending duration; a batch runs while earlier batches left some budget.

    Adds ``batch``, ``spent_before`` (cost of all earlier batches) and ``processed``.
    """
    order = ["duration", "seg_idx"]
    ranked = settle(
        running(items, [MEDIA], order, layout, _rank=row_index()).withColumn(
            "batch", F.floor(F.col("_rank") / batch_size).cast("bigint")
        ),
        layout,
    )
    costs = ranked.groupBy(MEDIA, "batch").agg(F.sum("duration").alias("cost"))
    spent = running(
        costs, [MEDIA], ["batch"], layout, spent_before=running_sum(F.col("cost"), inclusive=False)
    ).drop("cost")
    return (
        ranked.drop("_rank")
        .join(spent, [MEDIA, "batch"])
        .withColumn("processed", F.col("spent_before") < budget)
    )
