"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links (a, b)``: root is the least node of its component.

    Each round takes the least label among a node and its neighbours and then the label of that label,
    so that chains halve; rounds follow the logarithm of the longest chain.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = lower.select(F.col("node").alias("at"), F.col("root").alias("over"))
        moved = lower.join(jump, lower.root == jump.at).select("node", F.least("root", "over").alias("root"))
        new = written(moved, "labels")
        if not new.join(labels.withColumnRenamed("root", "old"), "node").filter("root != old").limit(1).count():
            return new
        labels = new
