"""Pairwise page similarity (J1-J5) without fitting a model per pair.

The per-pair TF-IDF (smoothed idf fitted on just the two texts, L2 norm) has a
closed form.  With n = 2 documents the idf of a shared term is 1 and of an
unshared one ``c = 1 + ln(3/2)``.  With ``N_d = sum tf^2`` over a document and
sums over shared terms only::

    dot = sum tf1*tf2     S1 = sum tf1^2     S2 = sum tf2^2
    sim = dot / sqrt((c^2 N1 - (c^2-1) S1) * (c^2 N2 - (c^2-1) S2))

so a pair needs only its shared terms (an equi-join on term) and two
per-page numbers.  A field with no token on either side, or a NULL title on
either side, makes the whole pair absent (distance 1.0 later).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SIM_FIELDS, SIM_WEIGHTS
from ..functions.text import sim_tokens
from ..session import by_page, cut, of_keys, parallelism

C_UNSHARED = 1.0 + math.log(1.5)
C2 = C_UNSHARED * C_UNSHARED

# source column of each similarity field
FIELD_SOURCE = {"url": "url_text", "title": "title", "fulltext": "fulltext", "plaintext": "plaintext"}


def sum_sq_tf(tokens: Column) -> Column:
    """sum over distinct terms of tf^2, inside the row: sort, then one pass that
    adds the square of every run length."""
    acc0 = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("long").alias("run"),
                    F.lit(0).cast("long").alias("ss"))

    def merge(acc, x):
        return F.when(x == acc["prev"], F.struct(acc["prev"].alias("prev"), (acc["run"] + 1).alias("run"),
                                                 acc["ss"].alias("ss"))) \
            .otherwise(F.struct(x.alias("prev"), F.lit(1).cast("long").alias("run"),
                                (acc["ss"] + acc["run"] * acc["run"]).alias("ss")))

    return F.aggregate(F.array_sort(tokens), acc0, merge, lambda acc: acc["ss"] + acc["run"] * acc["run"])


def page_vectors(fields: DataFrame) -> DataFrame:
    """``simvec(domain, page_id, field, term, tf)`` for the four similarity fields."""
    per_field = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), sim_tokens(F.col(FIELD_SOURCE[f])).alias("toks"))
        for f in SIM_FIELDS
    ]))
    t = by_page(fields).select("domain", "page_id", per_field.alias("x"))
    t = t.select("domain", "page_id", F.col("x.field").alias("field"), F.explode("x.toks").alias("term"))
    return t.groupBy("domain", "page_id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def shared_vectors(vectors: DataFrame) -> DataFrame:
    """Drop the terms that occur in a single page of a site (per field): no
    pair can share them, and the per-page norms already count them.  Saves
    their rows in every later pair join; exact for both pair modes."""
    df = vectors.groupBy("domain", "field", "term").agg(F.count(F.lit(1)).alias("_df"))
    return vectors.join(df.where("_df >= 2").drop("_df"), ["domain", "field", "term"], "left_semi")


def page_norms(fields: DataFrame) -> DataFrame:
    """``(domain, page_id, n_url, n_title, n_fulltext, n_plaintext, title_ok)``:
    sum tf^2 per field (0 = no token) and whether the title is usable.
    Row-local, no shuffle."""
    return fields.select(
        "domain", "page_id",
        *[sum_sq_tf(sim_tokens(F.col(FIELD_SOURCE[f]))).alias(f"n_{f}") for f in SIM_FIELDS],
        F.col("title").isNotNull().alias("title_ok"),
    )


def _pair_score(dot, s1, s2, n1, n2) -> Column:
    den = F.sqrt((F.lit(C2) * n1 - F.lit(C2 - 1.0) * s1) * (F.lit(C2) * n2 - F.lit(C2 - 1.0) * s2))
    return F.when(dot > 0, dot / den).otherwise(F.lit(0.0))


def _valid_pair(a_prefix: str, b_prefix: str) -> Column:
    ok = F.col(f"{a_prefix}title_ok") & F.col(f"{b_prefix}title_ok")
    for f in SIM_FIELDS:
        ok = ok & ((F.col(f"{a_prefix}n_{f}") > 0) | (F.col(f"{b_prefix}n_{f}") > 0))
    return ok


def hit_pair_similarity(hits: DataFrame, vectors: DataFrame, norms: DataFrame) -> DataFrame:
    """J1/J2 in pair-limited mode: the four scores of every pair of hits of a
    query, ``(query_id, rank_a, rank_b, url_a, url_b, <field>_sim_score...)``
    with ``rank_a < rank_b``.

    The hits' vectors are joined to the hits; a self-join on
    query, field and term gives the shared terms of the hit pairs (at most
    C(k,2) per term and query); absent pairs are those J2 drops.
    """
    # hits (four narrow columns, k rows per query) are spread over the cores
    # by query before each fans out into its page's vector rows; these carry a
    # number of the query and of the field, not their names
    numbered = cut(hits.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()))
    h = hits.select("query_id", "domain", "page_id", "rank").join(numbered, "query_id").drop("query_id").repartition(
        parallelism(hits.sparkSession), "q")
    place = F.array_position(F.array(*[F.lit(f) for f in SIM_FIELDS]), F.col("field")).cast("int")
    hv = h.join(of_keys(vectors, hits, "domain", "page_id"), ["domain", "page_id"]).select("q", place.alias("f"), "term", "rank", "tf")
    # one DataFrame joined with itself: both sides are the same plan, so its
    # shuffle on (q, f, term) runs once and is reused
    x, y = hv.alias("x"), hv.alias("y")
    shared = x.join(y, (F.col("x.q") == F.col("y.q")) & (F.col("x.f") == F.col("y.f"))
                    & (F.col("x.term") == F.col("y.term")) & (F.col("x.rank") < F.col("y.rank"))).select(
        F.col("x.q").alias("q"), F.col("x.f").alias("f"),
        F.col("x.rank").alias("rank_a"), F.col("y.rank").alias("rank_b"),
        F.col("x.tf").alias("tf_a"), F.col("y.tf").alias("tf_b"))
    sums = shared.groupBy("q", "rank_a", "rank_b").agg(*[
        agg for i, f in enumerate(SIM_FIELDS, 1) for agg in (
            F.sum(F.when(F.col("f") == i, F.col("tf_a") * F.col("tf_b"))).alias(f"dot_{f}"),
            F.sum(F.when(F.col("f") == i, F.col("tf_a") * F.col("tf_a"))).alias(f"s1_{f}"),
            F.sum(F.when(F.col("f") == i, F.col("tf_b") * F.col("tf_b"))).alias(f"s2_{f}"))
    ])
    sums = sums.join(numbered, "q").drop("q")
    hn = hits.select("query_id", "domain", "page_id", "rank", "url").join(norms, ["domain", "page_id"])
    ha = hn.select("query_id", F.col("rank").alias("rank_a"), F.col("url").alias("url_a"),
                   *[F.col(f"n_{f}").alias(f"a_n_{f}") for f in SIM_FIELDS],
                   F.col("title_ok").alias("a_title_ok"))
    hb = hn.select("query_id", F.col("rank").alias("rank_b"), F.col("url").alias("url_b"),
                   *[F.col(f"n_{f}").alias(f"b_n_{f}") for f in SIM_FIELDS],
                   F.col("title_ok").alias("b_title_ok"))
    pairs = ha.join(hb, "query_id").where(F.col("rank_a") < F.col("rank_b"))
    pairs = pairs.where(_valid_pair("a_", "b_"))
    p = pairs.join(sums, ["query_id", "rank_a", "rank_b"], "left")
    return p.select(
        "query_id", "rank_a", "rank_b", "url_a", "url_b",
        *[_pair_score(F.coalesce(F.col(f"dot_{f}"), F.lit(0)), F.coalesce(F.col(f"s1_{f}"), F.lit(0)),
                      F.coalesce(F.col(f"s2_{f}"), F.lit(0)), F.col(f"a_n_{f}"), F.col(f"b_n_{f}"))
          .alias(f"{f}_sim_score") for f in SIM_FIELDS])


def weighted_similarity(weights: dict | None = None) -> Column:
    w = weights or SIM_WEIGHTS
    return sum((F.lit(w[f]) * F.col(f"{f}_sim_score") for f in SIM_FIELDS[1:]),
               F.lit(w[SIM_FIELDS[0]]) * F.col(f"{SIM_FIELDS[0]}_sim_score"))


def weighted_distance(weights: dict | None = None) -> Column:
    """``1 - sum w*score`` clipped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - weighted_similarity(weights)))


def hit_distances(hits: DataFrame, pair_sims: DataFrame, weights: dict | None = None) -> DataFrame:
    """``dist(query_id, rank_a, rank_b, d)`` for every pair of hits
    (rank_a < rank_b); a pair without a similarity row is at distance 1.0."""
    h = hits.select("query_id", "rank")
    pairs = (h.select("query_id", F.col("rank").alias("rank_a"))
             .join(h.select("query_id", F.col("rank").alias("rank_b")), "query_id")
             .where(F.col("rank_a") < F.col("rank_b")))
    d = pair_sims.select("query_id", "rank_a", "rank_b", weighted_distance(weights).alias("d"))
    return pairs.join(d, ["query_id", "rank_a", "rank_b"], "left").select(
        "query_id", "rank_a", "rank_b", F.coalesce(F.col("d"), F.lit(1.0)).alias("d"))
