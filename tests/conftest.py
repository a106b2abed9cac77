import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="clusterscope-test-ckpt-")
    s = (SparkSession.builder.master("local[4]")
         .appName("clusterscope-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


MINI_SITE = [
    (0, "https://toolshed.org/tools/laser", "Laser cutter", "laser cutter training for members",
     "laser cutter training"),
    (1, "https://toolshed.org/tools/saw", "Table saw", "table saw training for members", "table saw training"),
    (2, "https://toolshed.org/tools/laser2", "Laser cutter", "laser cutter guide for members",
     "laser cutter training guide"),
    (3, "https://toolshed.org/about", "About", "our history and staff", "our history"),
]


@pytest.fixture(scope="session")
def mini_fields(spark):
    """Golden mini-site given as page fields (no HTML step)."""
    from pyspark.sql import functions as F

    from clusterscope.functions.urls import strip_domain, url_hash

    df = spark.createDataFrame(
        [("toolshed.org", pid, url, title, full, plain) for pid, url, title, full, plain in MINI_SITE],
        "domain string, page_id long, url string, title string, fulltext string, plaintext string")
    return df.select("domain", "page_id", "url", url_hash("url").alias("url_hash"),
                     strip_domain(F.col("url"), F.col("domain")).alias("url_text"),
                     "title", "plaintext", "fulltext")


@pytest.fixture(scope="session")
def mini_hits(spark, mini_fields):
    """All four pages as the hits of one query, hit order = page order."""
    from pyspark.sql import functions as F

    return mini_fields.select(F.lit("q").alias("query_id"), F.lit("q").alias("base_id"), "domain",
                              (F.col("page_id") + 1).cast("int").alias("rank"), "page_id", "url", "title",
                              (F.lit(10.0) - F.col("page_id")).alias("score"))
