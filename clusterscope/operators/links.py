"""Links (P3) and crawl reachability (P4) over the page table.

``page_links`` resolves every anchor of every page against the page URL,
drops the fragment, sorts query arguments, keeps http(s) targets inside the
page's domain and de-duplicates per page.  ``reachable_pages`` is the crawl
closure as a breadth-first join loop: ``frontier JOIN links`` minus the
visited set, one level per iteration, each level checkpointed to the shared
checkpoint folder so lineage never grows with the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_hrefs
from ..functions.urls import netloc
from ..session import cut

SCHEME_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def canonical_url(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base``; drop the fragment; sort query args."""
    h = F.trim(F.regexp_replace(href, F.lit(r"#.*$"), F.lit("")))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_replace(F.regexp_replace(base, F.lit(r"[?#].*$"), F.lit("")), F.lit(r"/[^/]*$"), F.lit("/"))
    base_dir = F.when(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/.*)?$", 1) == "",
                      F.concat(origin, F.lit("/"))).otherwise(base_path)
    absolute = (F.when(h.rlike(SCHEME_PATTERN), h)
                .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
                .when(h.startswith("/"), F.concat(origin, h))
                .when(h.startswith("?"), F.concat(F.regexp_replace(base, F.lit(r"[?#].*$"), F.lit("")), h))
                .when(h == "", F.regexp_replace(base, F.lit(r"#.*$"), F.lit("")))
                .otherwise(F.concat(base_dir, h)))
    path = F.regexp_extract(absolute, r"^([^?]*)", 1)
    query = F.regexp_extract(absolute, r"\?(.*)$", 1)
    sorted_q = F.array_join(F.array_sort(F.array_remove(F.split(query, "&"), "")), "&")
    return F.when(sorted_q == "", path).otherwise(F.concat(path, F.lit("?"), sorted_q))


def page_links(pages: DataFrame) -> DataFrame:
    """``links(domain, src_page_id, src, dst)``, unique per page."""
    raw = pages.select("domain", F.col("page_id").alias("src_page_id"), "url",
                       F.explode(extract_hrefs(F.col("html"))).alias("href"))
    c = raw.select("domain", "src_page_id", canonical_url(F.col("url"), F.col("url")).alias("src"),
                   canonical_url(F.col("href"), F.col("url")).alias("dst"))
    c = c.where(F.lower(F.col("dst")).rlike(r"^https?://"))
    c = c.where(F.instr(netloc(F.col("dst")), F.col("domain")) > 0)
    return c.distinct()


def start_pages(pages: DataFrame) -> DataFrame:
    """Stand-in for the configured start URL of each domain: its first page
    (an aggregate, combined map-side, so a huge domain is no single task)."""
    first = pages.groupBy("domain").agg(F.min_by("url", "page_id").alias("url"))
    return first.select("domain", canonical_url(F.col("url"), F.col("url")).alias("start"))


def reachable_pages(pages: DataFrame, links: DataFrame | None = None, starts: DataFrame | None = None,
                    max_depth: int | None = None) -> DataFrame:
    """``(domain, url, depth, is_page, saved)`` — every URL reached from the
    domain's start URL by following in-domain links, each once, at its BFS
    depth.  ``saved`` marks what the crawler stores: every reached page except
    the start page, which is stored only if some crawled page links back to it."""
    links = links if links is not None else page_links(pages)
    starts = starts if starts is not None else start_pages(pages)
    edges = links.select(F.col("domain").alias("e_domain"), "src", "dst").distinct()
    page_urls = pages.select(F.col("domain").alias("p_domain"),
                             canonical_url(F.col("url"), F.col("url")).alias("u")).distinct()
    frontier = starts.select("domain", F.col("start").alias("url"), F.lit(0).alias("depth"))
    visited = cut(frontier)
    frontier = visited
    depth = 0
    while True:
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        # only stored pages have outgoing links
        nxt = (frontier.join(edges, (F.col("domain") == F.col("e_domain")) & (F.col("url") == F.col("src")))
               .select("domain", F.col("dst").alias("url")).distinct()
               .join(visited.select("domain", "url"), ["domain", "url"], "left_anti")
               .withColumn("depth", F.lit(depth)))
        nxt = cut(nxt)
        if nxt.isEmpty():
            break
        visited = cut(visited.unionByName(nxt))
        frontier = nxt
    linked_to = edges.select(F.col("e_domain").alias("domain"), F.col("dst").alias("url")).distinct() \
        .withColumn("_in", F.lit(True))
    out = (visited.join(page_urls, (F.col("domain") == F.col("p_domain")) & (F.col("url") == F.col("u")), "left")
           .select("domain", "url", "depth", F.col("u").isNotNull().alias("is_page")))
    out = out.join(linked_to, ["domain", "url"], "left")
    return out.select("domain", "url", "depth", "is_page",
                      (F.col("is_page") & ((F.col("depth") > 0) | F.coalesce("_in", F.lit(False)))).alias("saved"))
