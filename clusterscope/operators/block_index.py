"""Top-k retrieval (Q1/Q5) that reads only the posting blocks which can reach the k-th score.

``build_blocks`` sorts every term's postings by impact and packs neighbours into blocks of at most ``BLOCK``
postings, with the block's largest impact next to it.  A search then takes three steps, all joins:

1. *Bounds.*  The query terms meet the block table's narrow columns (no postings).  Each block's bound is its
   own maximum plus the largest impacts of the query's other terms: no page in it can score more.
2. *Floor.*  The best block of every term is read; the k-th best of the partial sums found there is a score that
   k pages certainly reach.  The terms of least impact that together stay below it are *minor*: a page that
   holds no other term is no result.
3. *Scores.*  Of the other terms those blocks are read whose bound reaches the floor.  A page that belongs to the
   result has a score of at least the floor, so every block that holds it has such a bound.  Pages that can
   still reach the floor with the minor terms look those up in the impacts, by page.  Their sums are complete,
   other pages' sums can only be too small, so the result is that of reading all postings.

Required and prohibited terms say nothing about impacts: a query with any reads all of its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOP_K
from ..session import cut
from .search import dismax_score, matched_pages, page_sums, query_terms

BLOCK = 128
# two pages count as tied at 9 places, so a block that falls short by less is read
MARGIN = 1e-8


def build_blocks(impacts: DataFrame, boosts: dict | None = None, size: int = BLOCK) -> DataFrame:
    """``blocks(domain, term, block, most, n, postings array<struct<page_id, s>>)``, ``s`` the boosted
    dismax impact of a posting.

    Rows are sorted over all tasks by term and falling impact, so a term that a third of the pages hold is
    spread; neighbours are numbered as they lie and grouped by ``size`` (combined before the shuffle)."""
    order = ["domain", "term", F.desc("s"), "page_id"]
    rows = (impacts.select("domain", "term", "page_id", dismax_score(boosts).alias("s")).where("s > 0")
            .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    posting = F.struct("page_id", "s")
    return rows.groupBy("domain", "term", F.expr(f"at div {size}").alias("block")).agg(
        F.max("s").alias("most"), F.count(F.lit(1)).alias("n"), F.collect_list(posting).alias("postings"))


def _met_blocks(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The query terms' blocks without their postings, per query and site: a query bound to a site
    meets that site's blocks only, by (domain, term); the others meet all by term."""
    qt, table = query_terms(queries), blocks.select("domain", "term", "block", "most", "n")
    bound = qt.where("q_domain is not null").withColumn("domain", F.col("q_domain")).join(table, ["domain", "term"])
    free = qt.where("q_domain is null").join(table, "term")
    met = bound.select("query_id", "q_domain", *[c for c in free.columns if c not in ("query_id", "q_domain")]).unionByName(free)
    return met.withColumn("base_id", F.col("query_id")).withColumn(
        "query_id", F.when(F.col("q_domain").isNull(), F.concat(F.col("base_id"), F.lit("@"), F.col("domain"))).otherwise(F.col("base_id")))


def _read(met: DataFrame, blocks: DataFrame) -> DataFrame:
    """The postings of the given blocks, a row each, with their share of the score."""
    rows = met.join(blocks.select("domain", "term", "block", "postings"), ["domain", "term", "block"])
    return rows.select("query_id", "base_id", "domain", "req", "proh", "n_req", "qtf", F.explode("postings").alias("p")).select(
        "query_id", "base_id", "domain", F.col("p.page_id").alias("page_id"), "req", "proh", "n_req", "qtf", (F.col("qtf") * F.col("p.s")).alias("s"))


def bounded_blocks(queries: DataFrame, blocks: DataFrame, k: int = TOP_K) -> DataFrame:
    """The blocks of every query and site with ``bound``, ``floor`` (null if none holds),
    ``minor`` and ``needed``."""
    met = cut(_met_blocks(queries, blocks))
    terms = met.groupBy("query_id", "domain", "term").agg((F.max("qtf") * F.max("most")).alias("top"))
    whole = terms.groupBy("query_id", "domain").agg(F.sum("top").alias("whole"))
    marked = met.groupBy("query_id").agg(F.max(F.col("req") | F.col("proh")).alias("marked"))
    best = met.groupBy("query_id", "domain", "term").agg(F.max_by("block", F.struct("most", -F.col("block"))).alias("block"))
    first = met.join(best, ["query_id", "domain", "term", "block"])
    partial = _read(first, blocks).where("qtf > 0").groupBy("query_id", "domain", "page_id").agg(F.sum("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "page_id"))
    floor = partial.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", F.col("s").alias("floor"))
    running = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = terms.withColumn("upto", F.sum("top").over(running))
    rows = (met.join(terms, ["query_id", "domain", "term"]).join(whole, ["query_id", "domain"]).join(marked, "query_id")
            .join(floor, "query_id", "left"))
    bound = F.col("whole") - F.col("top") + F.col("qtf") * F.col("most")
    all_of_it, least = F.col("marked") | F.col("floor").isNull(), F.col("floor") - MARGIN
    return (rows.withColumn("minor", ~all_of_it & (F.col("upto") < least)).withColumn("bound", bound)
            .withColumn("needed", all_of_it | (~F.col("minor") & (bound >= least))))


def _scored_rows(queries: DataFrame, blocks: DataFrame, impacts: DataFrame, boosts: dict | None, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All blocks with their marks, the pages found in blocks that can still reach the floor (a row each, see
    ``page_sums``), and the postings looked up by page."""
    marks = cut(bounded_blocks(queries, blocks, k))
    minor = marks.where("minor").groupBy("query_id", "domain", "term").agg(*(F.first(c).alias(c) for c in ("req", "proh", "n_req", "qtf", "top", "floor")))
    rest = minor.groupBy("query_id").agg(F.sum("top").alias("rest"), F.first("floor").alias("floor"))
    found = page_sums(_read(marks.where("needed"), blocks)).join(rest, "query_id", "left")
    # without minor terms every page stays; the others' sums are below the floor whatever those add
    found = cut(found.where(F.col("rest").isNull() | (F.col("s") + F.col("rest") >= F.col("floor") - MARGIN)))
    near = found.where("rest is not null").select("query_id", "base_id", "domain", "page_id")
    asked = near.join(minor.drop("top", "floor"), ["query_id", "domain"])
    looked = asked.join(impacts.select("domain", "term", "page_id", dismax_score(boosts).alias("impact")), ["domain", "term", "page_id"])
    looked = looked.where("impact > 0").select("query_id", "base_id", "domain", "page_id", "req", "proh", "n_req", "qtf", (F.col("qtf") * F.col("impact")).alias("s"))
    return marks, found.drop("rest", "floor"), looked


def block_scores(queries: DataFrame, blocks: DataFrame, impacts: DataFrame, boosts: dict | None = None, k: int = TOP_K) -> DataFrame:
    """``(query_id, base_id, domain, page_id, score)`` like ``match_scores``, complete for every page that the
    ``k`` best of its query hold.  ``blocks`` are built from ``impacts`` with the same boosts."""
    _, found, looked_up = _scored_rows(queries, blocks, impacts, boosts, k)
    return matched_pages(found.unionByName(page_sums(looked_up)))


def block_reads(queries: DataFrame, blocks: DataFrame, impacts: DataFrame, boosts: dict | None = None, k: int = TOP_K) -> DataFrame:
    """``(query_id, domain, postings, read)``: a query's postings on a site, and those that its scores are
    summed up from (read in blocks or looked up)."""
    marks, _, looked_up = _scored_rows(queries, blocks, impacts, boosts, k)
    met = marks.groupBy("query_id", "domain").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("needed"), F.col("n"))), F.lit(0)).alias("in_blocks"))
    looked = looked_up.groupBy("query_id").agg(F.count(F.lit(1)).alias("looked"))
    return met.join(looked, "query_id", "left").select("query_id", "domain", "postings", (F.col("in_blocks") + F.coalesce("looked", F.lit(0))).alias("read"))
