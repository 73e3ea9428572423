"""Connected components of an edge table by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node that can be reached.

    Each round gives a node the smallest label among itself and its neighbours, then follows labels once more
    (pointer jumping), so that the number of rounds grows with the logarithm of a chain's length.  Labels are
    pre-aggregated before every shuffle and written to the shared folder after it; the driver sees one count a round.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().toDF("a", "b"), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        # the label's own node also hears of it, so that whole trees merge and not only their leaves
        heard = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), F.col("component").alias("c"))
        near = heard.groupBy("node").agg(F.min("c").alias("c"))
        mine = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        told = mine.select("node", "c").union(mine.select("component", "c")).groupBy("node").agg(F.min("c").alias("c"))
        jump = told.alias("x").join(told.alias("y"), F.col("x.c") == F.col("y.node"), "left").select(
            F.col("x.node").alias("node"), F.least("x.c", F.coalesce("y.c", "x.c")).alias("component"))
        after = stored(jump, "labels")
        moved = after.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").limit(1).count()
        labels = after
        if not moved:
            return labels
