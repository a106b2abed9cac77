"""Page preparation (P1, P2, P5-P11): one narrow extraction stage + URL dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import extract_fulltext, extract_plaintext, extract_title, strip_invisible
from ..functions.urls import in_domain, page_key, strip_domain, url_hash


def html_only(pages: DataFrame) -> DataFrame:
    """Keep responses whose content type mentions html (if the column exists)."""
    if "content_type" not in pages.columns:
        return pages
    return pages.where(F.col("content_type").contains("html"))


def keep_in_domain(pages: DataFrame) -> DataFrame:
    """Keep pages whose netloc contains their domain as a substring."""
    return pages.where(in_domain(F.col("url"), F.col("domain")))


def dedupe_urls(pages: DataFrame, keep: str = "first") -> DataFrame:
    """One row per (domain, url); ``first`` = lowest page_id wins
    (manifest order), ``last`` = highest wins (the indexer's id overwrite)."""
    order = F.col("page_id").asc() if keep == "first" else F.col("page_id").desc()
    w = Window.partitionBy("domain", "url").orderBy(order)
    return pages.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def page_fields(pages: DataFrame, fixed_strip: bool = False, dedupe: bool = True) -> DataFrame:
    """``(domain, page_id, url, url_hash, url_text, title, plaintext, fulltext)``.

    Extraction is narrow (no shuffle); only the URL dedupe shuffles, after
    the HTML is dropped, on ``(domain, url)``.
    """
    p = keep_in_domain(html_only(pages))
    # comments, scripts and styles removed once; the three extractors share it
    p = p.select("domain", "page_id", "url", strip_invisible(F.col("html")).alias("_clean"))
    out = p.select(
        "domain", "page_id", "url",
        url_hash("url").alias("url_hash"),
        strip_domain(F.col("url"), F.col("domain"), fixed=fixed_strip).alias("url_text"),
        extract_title(F.col("_clean"), F.col("url"), cleaned=True).alias("title"),
        extract_plaintext(F.col("_clean"), cleaned=True).alias("plaintext"),
        extract_fulltext(F.col("_clean"), cleaned=True).alias("fulltext"),
    )
    return dedupe_urls(out) if dedupe else out


def page_keys(pages: DataFrame, max_len: int = 210, keep_len: int = 200) -> DataFrame:
    """P5: file key of each page — the percent-quoted URL; keys longer than
    ``max_len`` become their first ``keep_len`` characters plus a counter
    (0, 1, ... in page order over the long keys of a domain, cut to 10 chars)."""
    k = pages.select("domain", "page_id", "url", page_key("url").alias("_q"))
    long_ = F.length("_q") > max_len
    short = k.where(~long_).select("domain", "page_id", "url", F.col("_q").alias("page_key"))
    # only the (rare) long keys are numbered, so the window never sees the
    # ordinary pages of a domain
    w = Window.partitionBy("domain").orderBy("page_id")
    counted = k.where(long_).select(
        "domain", "page_id", "url",
        F.concat(F.substring("_q", 1, keep_len),
                 F.substring((F.row_number().over(w) - 1).cast("string"), 1, 10)).alias("page_key"))
    return short.unionByName(counted)
