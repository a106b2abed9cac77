"""The inconsistency cut of dendrograms (C10) as joins and aggregates over a merge table.

``merges(query_id, node, left, right, height)`` holds one row per merge of a group's
dendrogram; leaves are numbered 0 to n - 1 in rank order, merges from n on, the root last.
Everything below is keyed by ``query_id``, so all groups of a batch are cut in one plan:
descendants come from joins of the child table with itself, coefficients from ``avg`` and
``stddev_samp``, clusters from an aggregate over the ancestors of each leaf.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LINKAGE_DEFAULT_METHOD, LINKAGE_DEPTH, LINKAGE_T, TOP_K
from ..session import cut, ship_package

MERGE_SCHEMA = "query_id string, node int, left int, right int, height double"
# below this, heights differ by rounding only and have no deviation
FLAT = 1e-9


def merge_table(dist: DataFrame, method: str = "") -> DataFrame:
    """The merges of every group of ``dist(query_id, rank_a, rank_b, d)``.

    A group holds the hits of one query (at most C(k, 2) distances) and is
    merged by one numpy routine; a query of one hit has no merges."""
    from .cluster_groups import distance_matrix, linkage

    ship_package(dist.sparkSession)
    method = method or LINKAGE_DEFAULT_METHOD

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks, m = distance_matrix(pdf)
        z = linkage(m, method)
        n = len(ranks)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "node": np.arange(n, 2 * n - 1, dtype="int32"),
                             "left": z[:, 0].astype("int32"), "right": z[:, 1].astype("int32"), "height": z[:, 2]})

    return dist.groupBy("query_id").applyInPandas(merged, schema=MERGE_SCHEMA)


def child_merges(merges: DataFrame) -> DataFrame:
    """``(query_id, node, child)`` for children that are merges themselves."""
    kids = merges.select("query_id", "node", F.explode(F.array("left", "right")).alias("child"))
    return kids.join(merges.select("query_id", F.col("node").alias("child")), ["query_id", "child"], "left_semi")


def inconsistency(merges: DataFrame, depth: int = LINKAGE_DEPTH) -> DataFrame:
    """``(query_id, node, mean, std, n, coef)``: the heights within ``depth`` levels of each
    merge, its own included (``depth - 1`` joins with the child table)."""
    kids, heights = child_merges(merges), merges.select("query_id", "node", "height")
    level = merges.select("query_id", F.col("node").alias("top"), "node")
    below = level
    for _ in range(depth - 1):
        level = level.join(kids, ["query_id", "node"]).select("query_id", "top", F.col("child").alias("node"))
        below = below.unionByName(level)
    stats = below.join(heights, ["query_id", "node"]).groupBy("query_id", F.col("top").alias("node")).agg(
        F.avg("height").alias("mean"), F.coalesce(F.stddev_samp("height"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
    coef = F.when(F.col("std") > FLAT, (F.col("height") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    return heights.join(stats, ["query_id", "node"]).select("query_id", "node", "mean", "std", "n", coef.alias("coef"))


def descendants(merges: DataFrame, most: int) -> DataFrame:
    """``(query_id, top, node)``: every merge with the merges below it, itself included.
    Paths double in length from join to join; ``most`` bounds the merges of a group."""
    reach = (child_merges(merges).select("query_id", F.col("node").alias("top"), F.col("child").alias("node"))
             .unionByName(merges.select("query_id", F.col("node").alias("top"), "node")))
    for _ in range(max(0, math.ceil(math.log2(max(most, 1))))):
        further = reach.select("query_id", F.col("top").alias("node"), F.col("node").alias("further"))
        reach = cut(reach.join(further, ["query_id", "node"]).select("query_id", "top", F.col("further").alias("node")).distinct())
    return reach


def flat_labels(hits: DataFrame, merges: DataFrame, t: float = LINKAGE_T, depth: int = LINKAGE_DEPTH, k: int = TOP_K) -> DataFrame:
    """``labels(query_id, rank, label)``: a merge whose coefficient and all its descendants'
    are <= t forms a cluster, the highest such merge above a leaf being the leaf's; other leaves are
    clusters of their own.  Labels count from 1 in the order of a walk from the root, left first.
    ``k`` bounds the hits of a query."""
    merges = cut(merges)
    reach = descendants(merges, k - 1)
    worst = (reach.join(inconsistency(merges, depth).select("query_id", "node", "coef"), ["query_id", "node"])
             .groupBy("query_id", F.col("top").alias("node")).agg(F.max("coef").alias("worst")))
    formed = worst.where(F.round("worst", 9) <= t).select("query_id", "node")
    leaves = hits.select("query_id", "rank", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).alias("leaf"))
    # the leaves below each side of each merge
    sides = merges.select("query_id", "node", F.posexplode(F.array("left", "right")).alias("side", "child"))
    direct = sides.join(leaves.select("query_id", F.col("leaf").alias("child")), ["query_id", "child"], "left_semi").select(
        "query_id", "node", "side", F.col("child").alias("leaf"))
    held = reach.join(direct.select("query_id", "node", "leaf"), ["query_id", "node"]).select("query_id", F.col("top").alias("child"), "leaf")
    under = cut(direct.unionByName(sides.join(held, ["query_id", "child"]).select("query_id", "node", "side", "leaf")))
    path = under.groupBy("query_id", "leaf").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("node")).alias("n"), F.col("side").cast("string").alias("side")))), lambda x: x["side"]), "").alias("path"))
    owner = under.join(formed, ["query_id", "node"]).groupBy("query_id", "leaf").agg(F.max("node").alias("owner"))
    # a leaf outside every formed merge stands for itself, with a number that no merge has
    placed = (leaves.join(path, ["query_id", "leaf"], "left").join(owner, ["query_id", "leaf"], "left")
              .withColumn("owner", F.coalesce("owner", -1 - F.col("leaf"))))
    first = placed.withColumn("first", F.min(F.coalesce("path", F.lit(""))).over(Window.partitionBy("query_id", "owner")))
    label = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first"))
    return first.select("query_id", "rank", label.cast("int").alias("label"))


def linkage_hit_labels(hits: DataFrame, dist: DataFrame, method: str = "") -> DataFrame:
    """C3-C10 for a batch of queries: merges per group, the cut as one plan over all of them."""
    return flat_labels(hits, merge_table(dist, method))
