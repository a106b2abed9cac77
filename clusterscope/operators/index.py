"""Inverted index (S5, M3) and per-field BM25 impacts (Q3).

Layout (all keyed by ``domain``):

* ``postings(domain, field, term, page_id, tf, positions)`` — positions kept for
  phrase queries;
* ``field_stats(domain, field, n_docs, avgdl)`` — one row per site and field;
* ``impacts(domain, term, page_id, s_title, s_plaintext, s_fulltext)`` — BM25
  of each field, query independent, so a search is one equi-join on
  ``term`` plus one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, SEARCH_FIELDS
from ..functions.text import search_tokens
from ..session import by_page, cut


def field_tokens(fields: DataFrame, columns=SEARCH_FIELDS, tokenizer=search_tokens) -> DataFrame:
    """``(domain, page_id, field, pos, term, dl)``: one row per token occurrence."""
    per_field = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), tokenizer(F.col(c)).alias("toks")) for c in columns
    ]))
    t = fields.select("domain", "page_id", per_field.alias("f"))
    t = t.select("domain", "page_id", F.col("f.field").alias("field"), F.col("f.toks").alias("toks"))
    t = t.select("domain", "page_id", "field", F.size("toks").alias("dl"),
                 F.posexplode("toks").alias("pos", "term"))
    return t


def build_postings(fields: DataFrame, with_positions: bool = True) -> DataFrame:
    """``(domain, field, term, page_id, tf, dl[, positions])``.

    The pages are dealt once by ``(domain, page_id)``; their tokens are grouped where they lie.
    """
    t = field_tokens(by_page(fields))
    aggs = [F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")]
    if with_positions:
        aggs.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return t.groupBy("domain", "field", "term", "page_id").agg(*aggs)


def doc_lengths(fields: DataFrame) -> DataFrame:
    """``(domain, field, page_id, dl)`` straight from the token arrays (no shuffle)."""
    per_field = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.size(search_tokens(F.col(c))).alias("dl"))
        for c in SEARCH_FIELDS
    ]))
    d = fields.select("domain", "page_id", per_field.alias("f"))
    return d.select("domain", F.col("f.field").alias("field"), "page_id", F.col("f.dl").alias("dl"))


def field_stats(fields: DataFrame) -> DataFrame:
    """``(domain, field, n_docs, avgdl)``: documents having the field (dl > 0) and
    their mean length.  One row per site and field — tiny, aggregated map-side."""
    d = doc_lengths(fields).where("dl > 0")
    return d.groupBy("domain", "field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(domain, field, term, df)``; a hot term collapses map-side to one row."""
    return postings.groupBy("domain", "field", "term").agg(F.count(F.lit(1)).alias("df"))


def bm25(tf, df, dl, n_docs, avgdl, k1: float = BM25_K1, b: float = BM25_B):
    """Lucene-7 BM25 of one field: idf * tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl))."""
    idf = F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def bm25_tf(tf, dl, avgdl, k1: float = BM25_K1, b: float = BM25_B):
    """The part of BM25 that depends on the page (without idf)."""
    return (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def term_frequencies(fields: DataFrame, columns: tuple = SEARCH_FIELDS) -> DataFrame:
    """``(domain, term, page_id, tf_<field>..., dl_<field>..., first_<field>...)``."""
    t = field_tokens(by_page(fields), columns)
    return t.groupBy("domain", "term", "page_id").agg(*[
        a for f in columns for a in (
            F.count(F.when(F.col("field") == f, 1)).alias(f"tf_{f}"),
            F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl_{f}"),
            # the row holding a page-field's first token carries its length once
            F.max(F.when((F.col("field") == f) & (F.col("pos") == 0), F.col("dl"))).alias(f"first_{f}"))
    ])


def build_impacts(fields: DataFrame, k1: float = BM25_K1, b: float = BM25_B,
                  columns: tuple = SEARCH_FIELDS) -> DataFrame:
    """Q3: ``impacts(domain, term, page_id, s_title, s_plaintext, s_fulltext)``.

    One aggregation on ``(domain, term, page_id)`` (over pages dealt by page, its
    rows written once as they are read three times) yields the tf and length of
    every field; document frequencies come from a second,
    map-side-combined aggregate on ``(domain, term)`` joined back — a term
    present in a third of all pages is one aggregated row plus a skew-split
    join (AQE), never one giant window partition.  Field statistics are one
    row per site (broadcast once AQE has measured them).
    """
    return impacts_of(cut(term_frequencies(fields, columns)), k1, b, columns)


def impacts_of(tf: DataFrame, k1: float = BM25_K1, b: float = BM25_B, columns: tuple = SEARCH_FIELDS) -> DataFrame:
    """``build_impacts`` from its written ``term_frequencies``."""
    df = tf.groupBy("domain", "term").agg(*[
        F.count(F.when(F.col(f"tf_{f}") > 0, 1)).alias(f"df_{f}") for f in columns])
    # per-site field statistics from the same aggregate (no second tokenisation)
    fs = tf.groupBy("domain").agg(*[
        a for f in columns for a in (
            F.count(F.col(f"first_{f}")).alias(f"n_{f}"),
            (F.sum(F.col(f"first_{f}")) / F.count(F.col(f"first_{f}"))).alias(f"avgdl_{f}"))
    ])
    # the statistics meet a site's terms first: all postings would be dealt out by site
    j = tf.join(df.join(fs, "domain"), ["domain", "term"])
    return j.select("domain", "term", "page_id", *[
        F.when(F.col(f"tf_{f}") > 0,
               bm25(F.col(f"tf_{f}"), F.col(f"df_{f}"), F.col(f"dl_{f}"), F.col(f"n_{f}"),
                    F.col(f"avgdl_{f}"), k1, b)).otherwise(F.lit(0.0)).alias(f"s_{f}")
        for f in columns])
