"""URL-map manifests (S1, S2, S4): text files of alternating URL / path lines.

A manifest may be one file or a folder of chunk files (``part-*``, ordered by
name); the line order is ``(file, position)``.  Reading splits each file into
positioned lines, pairs line 2k with 2k+1 by aggregation, cuts each file at
its first blank URL line and de-duplicates URLs in manifest order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_urlmap(spark: SparkSession, path: str, mode: str = "first") -> DataFrame:
    """``urlmap(file, pos, url, path)``.

    ``mode='first'`` (S1): both lines stripped, reading stops at the first
    blank URL line, an odd tail URL gets an empty path, a repeated URL keeps
    its first occurrence.  ``mode='last'`` (S2): lines taken as they are,
    reading stops at an odd tail line, a repeated URL keeps its last
    occurrence (later rows overwrite earlier ones).
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = raw.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    k = F.floor(F.col("pos") / 2).cast("long")
    pairs = lines.groupBy("file", k.alias("k")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("line"))).alias("url"),
        F.max(F.when(F.col("pos") % 2 == 1, F.col("line"))).alias("path"))
    if mode == "first":
        strip = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
        pairs = pairs.select("file", "k", strip(F.col("url")).alias("url"),
                             F.coalesce(strip(F.col("path")), F.lit("")).alias("path"))
        stop = pairs.where(F.col("url") == "").groupBy("file").agg(F.min("k").alias("stop"))
    else:
        stop = pairs.where(F.col("path").isNull() | (F.col("url") == "")).groupBy("file").agg(
            F.min("k").alias("stop"))
    kept = pairs.join(stop, "file", "left").where(F.col("stop").isNull() | (F.col("k") < F.col("stop")))
    order = F.col("k").asc() if mode == "first" else F.col("k").desc()
    w = Window.partitionBy("url").orderBy(F.col("file").asc() if mode == "first" else F.col("file").desc(), order)
    out = kept.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return out.select("file", F.col("k").alias("pos"), "url", "path")


def write_urlmap(pages: DataFrame, path: str, partitions: int | None = None, run: str | None = None) -> None:
    """Write the manifest of ``pages(domain, page_id, url, path)``, one
    folder per domain; range partitioning on ``(domain, page_id)`` splits a
    big domain over several ordered chunk files instead of one task.

    ``run`` appends a crawl to an existing manifest: each run is its own
    ``run=<label>`` folder, so readers order runs by label, then chunks."""
    if run is not None:
        path = f"{path.rstrip('/')}/run={run}"
    lines = pages.select("domain", "page_id", F.explode(F.array(
        F.struct(F.lit(0).alias("j"), F.col("url").alias("line")),
        F.struct(F.lit(1).alias("j"), F.col("path").alias("line")))).alias("x"))
    lines = lines.select("domain", "page_id", F.col("x.j").alias("j"), F.col("x.line").alias("line"))
    n = partitions or lines.sparkSession.sparkContext.defaultParallelism
    (lines.repartitionByRange(n, "domain", "page_id")
     .sortWithinPartitions("domain", "page_id", "j")
     .select("domain", "line")
     .write.mode("overwrite").partitionBy("domain").text(path))
