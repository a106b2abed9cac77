"""From per-hit labels to ranked clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_METRICS = {
    "max_score": "score_max",
    "median_score": "score_median",
    "sum_score": "score_sum",
}


def relabel_noise(labels: DataFrame) -> DataFrame:
    """Every noise hit (label < 0) becomes its own cluster -1, -2, ... in
    hit order; ``cluster_id`` is the label as a string."""
    w = Window.partitionBy("query_id", F.col("label") < 0).orderBy("rank")
    lab = F.when(F.col("label") < 0, -F.row_number().over(w)).otherwise(F.col("label"))
    return labels.select("query_id", "rank", lab.cast("string").alias("cluster_id"))


def assemble_clusters(hits: DataFrame, cluster_ids: DataFrame, with_results: bool = False) -> DataFrame:
    """C14: one row per cluster — size, members in hit order, first member's
    rank, and the max / median / sum of member scores (exact median)."""
    h = hits.join(cluster_ids, ["query_id", "rank"])
    aggs = [
        F.count(F.lit(1)).alias("size"),
        F.min("rank").alias("first_rank"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("rank")), lambda r: r.cast("string")))
        .alias("members"),
        F.max("score").alias("score_max"),
        F.median("score").alias("score_median"),
        F.sum("score").alias("score_sum"),
    ]
    if with_results:
        aggs.append(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "score"))).alias("results"))
    return h.groupBy("query_id", "domain", "cluster_id").agg(*aggs)


def rank_clusters(clusters: DataFrame, rank_alg: str | None = None) -> DataFrame:
    """A1-A4: ``cluster_rank`` 1.. per query by the chosen metric, descending;
    ties keep first-member order (a stable sort).  ``rank_alg`` None -> read
    the per-query ``rank_alg`` column (defaults to max_score)."""
    from .registry import get, names

    tables = names("rank_table")
    if rank_alg is not None and rank_alg.lower() in tables:
        told = get("rank_table", rank_alg)(clusters).select("query_id", "cluster_id", F.col("metric").alias("_told"))
        clusters = clusters.join(told, ["query_id", "cluster_id"], "left")
        w = Window.partitionBy("query_id").orderBy(F.round("_told", 9).desc_nulls_last(), F.col("first_rank").asc())
        return clusters.withColumn("cluster_rank", F.row_number().over(w)).drop("_told")
    if rank_alg is not None:
        metric = get("rank", rank_alg)(clusters)
    else:
        metric = F.col("score_max")
        for name in tables:
            own = F.lower(F.coalesce(F.col("rank_alg"), F.lit("max_score"))) == name
            told = get("rank_table", name)(clusters.where(own)).select("query_id", "cluster_id", F.col("metric").alias(f"_told_{name}"))
            clusters = clusters.join(told, ["query_id", "cluster_id"], "left")
            metric = F.when(own, F.col(f"_told_{name}")).otherwise(metric)
        for name in names("rank"):
            metric = F.when(F.lower(F.coalesce(F.col("rank_alg"), F.lit("max_score"))) == name,
                            get("rank", name)(clusters)).otherwise(metric)
    w = Window.partitionBy("query_id").orderBy(F.round(metric, 9).desc_nulls_last(), F.col("first_rank").asc())
    return clusters.withColumn("cluster_rank", F.row_number().over(w)).drop(*(f"_told_{name}" for name in tables))
