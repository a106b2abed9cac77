"""DBSCAN over the hits of each query (C1), as column expressions.

A query has at most k hits (the top-k of the search), so its edge list is
bounded by C(k, 2).  One aggregation per query gathers it; label propagation
then runs inside the row with higher-order array functions (JVM-side):
``labels[i] = min(labels[i], labels[j] for core neighbours j)``, repeated n
times (a component's diameter is below n).

Semantics with precomputed distances, ``eps`` and ``min_samples`` (the point
itself counted): a point with at least ``min_samples - 1`` neighbours within
``eps`` is core; core points within ``eps`` share a cluster; a non-core point
within ``eps`` of a core point joins the lowest-numbered such cluster; the
rest is noise (-1).  Clusters are numbered 0, 1, ... by their first member in
hit order.  For ``min_samples = 2`` every non-noise point is core, and the
clusters are exactly the connected components of the ``d <= eps`` graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DBSCAN_EPS, DBSCAN_MIN_SAMPLES


def _edges(dist: DataFrame, eps: float) -> DataFrame:
    e = dist.where(F.col("d") <= eps)
    both = e.select("query_id", F.col("rank_a").alias("a"), F.col("rank_b").alias("b")).unionByName(
        e.select("query_id", F.col("rank_b").alias("a"), F.col("rank_a").alias("b")))
    return both


def dbscan_labels(hits: DataFrame, dist: DataFrame, eps: float = DBSCAN_EPS,
                  min_samples: int = DBSCAN_MIN_SAMPLES) -> DataFrame:
    """``labels(query_id, rank, label)``; -1 = noise."""
    n_per_q = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    ed = _edges(dist, eps).groupBy("query_id").agg(
        F.collect_list(F.struct("a", "b")).alias("edges"))
    g = n_per_q.join(ed, "query_id", "left").select(
        "query_id", "n", F.coalesce("edges", F.array().cast("array<struct<a:int,b:int>>")).alias("edges"))

    idx = F.sequence(F.lit(1), F.col("n"))
    deg = F.transform(idx, lambda i: F.size(F.filter(F.col("edges"), lambda e: e["a"] == i)))
    g = g.withColumn("core", F.transform(deg, lambda c: c + 1 >= min_samples))
    core_edges = F.filter(F.col("edges"), lambda e: F.element_at(F.col("core"), e["a"])
                          & F.element_at(F.col("core"), e["b"]))
    g = g.withColumn("cedges", core_edges)

    def relax(labels, _):
        return F.transform(labels, lambda l, i: F.least(l, F.array_min(F.transform(
            F.filter(F.col("cedges"), lambda e: e["a"] == i + 1),
            lambda e: F.element_at(labels, e["b"])))))

    comp = F.aggregate(F.sequence(F.lit(1), F.col("n")), idx, relax)
    g = g.withColumn("comp", comp)
    # component root -> cluster number by order of first core member
    roots = F.array_sort(F.array_distinct(F.filter(
        F.transform(idx, lambda i: F.when(F.element_at(F.col("core"), i), F.element_at(F.col("comp"), i))),
        lambda x: x.isNotNull())))
    g = g.withColumn("roots", roots)
    core_label = lambda i: F.array_position(F.col("roots"), F.element_at(F.col("comp"), i)) - 1
    # border point: lowest cluster among its core neighbours
    border_label = lambda i: F.array_min(F.transform(
        F.filter(F.col("edges"), lambda e: (e["a"] == i) & F.element_at(F.col("core"), e["b"])),
        lambda e: F.array_position(F.col("roots"), F.element_at(F.col("comp"), e["b"])) - 1))
    labels = F.transform(idx, lambda i: F.when(F.element_at(F.col("core"), i), core_label(i))
                         .otherwise(F.coalesce(border_label(i), F.lit(-1))))
    out = g.select("query_id", F.posexplode(labels).alias("pos", "label"))
    out = out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"),
                     F.col("label").cast("int").alias("label"))
    return out.join(hits.select("query_id", "rank"), ["query_id", "rank"])
