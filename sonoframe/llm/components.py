"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes in links (a, b): the smallest node that can be reached.

    Each round takes the least label of the neighbours, then the label of that label, and is written to the shared
    folder; rounds grow with the logarithm of a component's diameter. Only counts come to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = settle(both, "component-edges")
    labels = settle(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels"
    )
    while True:
        met = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("met"))
        )
        lower = labels.join(met, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "met").alias("component")
        )
        lower = settle(lower, "labels-lower")
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = settle(
            lower.join(roots, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("root", "component")).alias("component")
            ),
            "labels-jumped",
        )
        if jumped.where(F.col("component") != F.col("old")).isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
