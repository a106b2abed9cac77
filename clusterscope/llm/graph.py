"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterscope.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``edges(a, b)``; component is the smallest node
    reachable.  Each round takes the least label among a node and its neighbours
    (a partial aggregate, so a hub sends one row per task), then jumps to the
    label's label; rounds stop when nothing changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("component")))
    while True:
        heard = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                 .agg(F.min("component").alias("heard")))
        least = labels.join(heard, "node").select("node", F.col("component").alias("was"),
                                                  F.least("component", "heard").alias("component"))
        to = least.select(F.col("node").alias("via"), F.col("component").alias("further"))
        jumped = cut(least.join(to, least.component == to.via, "left")
                     .select("node", "was", F.coalesce("further", "component").alias("component")))
        if jumped.where("component <> was").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
