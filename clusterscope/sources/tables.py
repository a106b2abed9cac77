"""Readers for the input tables (S3, S11) and the query table built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (CLUSTER_ALGORITHMS, DEFAULT_CLUSTER_ALG, DEFAULT_RANK_ALG,
                      DEFAULT_SUMMARY_ALG, RANK_ALGORITHMS, SUMMARY_ALGORITHMS)
from ..functions.text import normalise_domain
from ..functions.urls import registered_domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: ``pages(domain, page_id, url, html)``; the domain is the site key of
    the URL (last two host labels), as a crawl of that domain would collect."""
    p = table(spark, sf_dir, "pages")
    return p.select(registered_domain("url").alias("domain"), "page_id", "url", "html")


def load_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate a query table ``(query_id, domain, query, cluster_alg,
    summary_alg, rank_alg)``.

    Missing algorithm names take the defaults, names are lower-cased, domains
    normalised; rows naming an unknown algorithm go to the second output.
    """
    q = queries.select(
        "query_id",
        normalise_domain(F.col("domain")).alias("domain"),
        "query",
        F.lower(F.coalesce(F.col("cluster_alg"), F.lit(DEFAULT_CLUSTER_ALG))).alias("cluster_alg"),
        F.lower(F.coalesce(F.col("summary_alg"), F.lit(DEFAULT_SUMMARY_ALG))).alias("summary_alg"),
        F.lower(F.coalesce(F.col("rank_alg"), F.lit(DEFAULT_RANK_ALG))).alias("rank_alg"),
    )
    from ..operators.registry import names

    cluster_ok = F.col("cluster_alg").isin(*CLUSTER_ALGORITHMS) | F.split("cluster_alg", "-")[0].isin(
        *[n for n in names("cluster") if n not in ("linkage",)])
    ok = (cluster_ok
          & F.col("summary_alg").isin(*sorted(set(SUMMARY_ALGORITHMS) | set(names("summary"))))
          & F.col("rank_alg").isin(*sorted(set(RANK_ALGORITHMS) | set(names("rank")))))
    return q.where(ok), q.where(~ok)


def append_query_log(queries: DataFrame, path: str) -> None:
    """Keep every submitted query (valid or not) — appended to a log table."""
    queries.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def benchmark_queries(spark: SparkSession, sf_dir: str, cluster_alg: str | None = None,
                      summary_alg: str | None = None, rank_alg: str | None = None) -> DataFrame:
    """The query batch of the registered jobs: every ``benchmark`` text, whole.

    ``domain`` is NULL: the query is asked on every site, and the search keys
    its result ``<query_id>@<domain>`` (see ``operators.search``).
    """
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"),
        F.lit(None).cast("string").alias("domain"),
        F.col("text").alias("query"),
        F.lit(cluster_alg).cast("string").alias("cluster_alg"),
        F.lit(summary_alg).cast("string").alias("summary_alg"),
        F.lit(rank_alg).cast("string").alias("rank_alg"),
    )


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as a second query source (all sites)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."),
                 F.col("turn").cast("string")).alias("query_id"),
        F.lit(None).cast("string").alias("domain"),
        F.col("text").alias("query"),
        F.lit(None).cast("string").alias("cluster_alg"),
        F.lit(None).cast("string").alias("summary_alg"),
        F.lit(None).cast("string").alias("rank_alg"),
    )
