"""The stored similarities' partitions, and plugins that work on whole tables."""

import os
import tempfile

from pyspark.sql import functions as F

from clusterscope.operators import registry
from clusterscope.operators.corpus import connected_components
from clusterscope.operators.groups import assemble_clusters, rank_clusters
from clusterscope.plans.grouped_search import cluster_labels
from clusterscope.sources.similarity_store import PREFIX, SCORES, StoredSimilarities, canonical_rows


def pairs(spark, n, score, first=0):
    return spark.range(first, first + n).select(F.concat(F.lit("http://s.org/a"), "id").alias("url_a"), F.concat(F.lit("http://s.org/b"), "id").alias("url_b"),
                                                *[F.lit(score).alias(c) for c in SCORES])


def files(root):
    return {os.path.join(b, f): os.path.getmtime(os.path.join(b, f)) for b, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_the_touched_partitions_only(spark):
    root = tempfile.mkdtemp(prefix="cs-store-")
    store = StoredSimilarities(spark, f"{root}/store")
    assert store.rows().count() == 0 and store.upsert(canonical_rows(pairs(spark, 0, 0.0))) == []
    assert 200 < len(store.upsert(canonical_rows(pairs(spark, 3000, 0.5)))) <= 16 ** PREFIX
    before = files(root)
    touched = store.upsert(canonical_rows(pairs(spark, 2, 0.9)))           # two known keys, scores replaced
    after = files(root)
    kept = {f for f in before if f in after}
    assert len(touched) <= 2 and len(kept) == len(before) - len(touched) and all(before[f] == after[f] for f in kept)
    store.upsert(canonical_rows(pairs(spark, 1, 0.7, first=5000)))
    got = store.rows().groupBy("plaintext_sim_score").count().collect()
    assert {(r[0], r[1]) for r in got} == {(0.5, 2998), (0.9, 2), (0.7, 1)}


def test_scan_prunes_partitions(spark):
    root = tempfile.mkdtemp(prefix="cs-store-")
    store = StoredSimilarities(spark, f"{root}/store")
    store.upsert(canonical_rows(pairs(spark, 500, 0.5)))
    hits = spark.createDataFrame([("q", 1, "http://s.org/a7"), ("q", 2, "http://s.org/b7"), ("q", 3, "http://s.org/a8")], "query_id string, rank int, url string")
    found = store.scan(hits)
    assert [(r.rank_a, r.rank_b, r.title_sim_score) for r in found.collect()] == [(1, 2, 0.5)]
    assert "PartitionFilters: [part#" in found._jdf.queryExecution().executedPlan().toString()


def test_table_plugins_at_any_group_size(spark):
    """A plugin that clusters a group of 3,000 by components of its edge table, next to one that ranks by a join."""
    def near(method, hits, dist):
        limit = float(method or "0.5")
        edges = dist.where(F.col("d") <= limit).select(F.col("query_id").alias("domain"), F.col("rank_a").alias("a"), F.col("rank_b").alias("b"))
        roots = connected_components(edges).select(F.col("domain").alias("query_id"), F.col("id").alias("rank"), F.col("root").alias("label"))
        return hits.select("query_id", "rank").join(roots, ["query_id", "rank"], "left").na.fill(-1, ["label"])

    n = 3000
    hits = spark.range(n).select(F.lit("whole").alias("query_id"), F.lit("s.org").alias("domain"), (F.col("id") + 1).cast("int").alias("rank"), (1.0 / (F.col("id") + 1)).alias("score"))
    small = spark.createDataFrame([("small", "s.org", 1, 1.0), ("small", "s.org", 2, 0.5)], hits.schema)
    dist = spark.range(n - 1).where("(id + 1) % 10 <> 0").select(F.lit("whole").alias("query_id"), (F.col("id") + 1).cast("int").alias("rank_a"), (F.col("id") + 2).cast("int").alias("rank_b"), F.lit(0.2).alias("d"))
    dist = dist.unionByName(spark.createDataFrame([("small", 1, 2, 0.1)], dist.schema))
    both = hits.unionByName(small)
    registry.register("cluster_table", "Near", near)
    registry.register("rank_table", "by_first", lambda c: c.select("query_id", "cluster_id", F.col("first_rank").cast("double").alias("metric")))
    try:
        algs = spark.createDataFrame([("whole", "near-0.3"), ("small", "dbscan")], "query_id string, cluster_alg string")
        labels = cluster_labels(both, dist, algs)
        sizes = {(r.query_id, r.n) for r in labels.groupBy("query_id", "label").agg(F.count("*").alias("n")).collect()}
        assert sizes == {("whole", 10), ("small", 2)}
        assert cluster_labels(both, dist, cluster_alg="NEAR-0.15").where("label >= 0").count() == 2
        clusters = assemble_clusters(both, labels.select("query_id", "rank", F.col("label").cast("string").alias("cluster_id")))
        top = rank_clusters(clusters, "by_first").where("query_id = 'whole' and cluster_rank <= 2").orderBy("cluster_rank").collect()
        assert [r.first_rank for r in top] == [2991, 2981]
        mixed = clusters.withColumn("rank_alg", F.when(F.col("query_id") == "whole", "by_first"))
        assert rank_clusters(mixed).where("query_id = 'whole' and cluster_rank = 1").first().first_rank == 2991
    finally:
        for category, name in (("cluster_table", "near"), ("rank_table", "by_first")):
            del registry._REG[category][name]
