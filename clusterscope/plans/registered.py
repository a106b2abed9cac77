"""The registered jobs: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every job reads the given tables (or the prepared tables Spark derives from
them, written once per input under ``spark.checkpoint.dir``) and runs over
all of their rows.  Doubles are rounded to 6 places so that results can be
compared order-insensitively against an independent SQL formulation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLUSTER_ALGORITHMS, SIM_FIELDS
from ..operators.block_index import build_blocks
from ..operators.cluster_small import dbscan_labels
from ..operators.groups import relabel_noise
from ..operators.index import build_impacts, build_postings, field_stats
from ..operators.labels import rake_summaries
from ..session import ensure_checkpoint_dir
from ..sources.similarity_store import StoredSimilarities, canonical_rows, scan
from ..sources.urlmap import read_urlmap, write_urlmap
from ..functions.text import search_tokens
from ..operators.lsa import (blurred_field, blurred_terms, fit_lsa, related_terms, singular_values,
                             term_vectors, topic_terms)
from ..operators.corpus import corpus_dbscan
from ..operators.message_passing import hit_similarities, message_round, start, tilted
from ..operators.links import page_links, reachable_pages
from ..operators.pages import page_keys
from ..operators.search import phrase_impacts, search
from ..operators.similarity import hit_distances, hit_pair_similarity
from ..sources.tables import benchmark_queries, conversation_queries, load_queries, read_pages
from ..session import cut
from .grouped_search import grouped_search, flat_search
from .prepare import materialize

R = 6


def _r(c: str):
    return F.round(F.col(c), R).alias(c)


def _prep(spark: SparkSession, sf_dir: str):
    return materialize(spark, sf_dir)


def _hits(spark, sf_dir, with_highlight=False, materialize=False):
    prep = _prep(spark, sf_dir)
    valid, _ = load_queries(benchmark_queries(spark, sf_dir))
    h = search(valid, prep.impacts, prep.fields, with_highlight=with_highlight, passages=prep.passages)
    return prep, valid, (cut(h) if materialize else h)


# -- page preparation -------------------------------------------------------
def q_page_fields(spark, sf_dir):
    f = _prep(spark, sf_dir).fields
    return f.select("domain", "page_id", "url", "url_hash", "url_text", "title", "plaintext", "fulltext")


def q_page_keys(spark, sf_dir):
    return page_keys(read_pages(spark, sf_dir))


def q_page_links(spark, sf_dir):
    return page_links(read_pages(spark, sf_dir))


def q_reachable_pages(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    return reachable_pages(pages, links=cut(page_links(pages)))


def q_urlmap(spark, sf_dir):
    """S4 then S1: write the pages' manifest (url, file key) per domain into the
    shared checkpoint folder and read it back with the first-wins reader."""
    pages = read_pages(spark, sf_dir)
    keys = page_keys(pages)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusterscope-urlmap/{uuid.uuid4().hex}"
    write_urlmap(keys.select("domain", "page_id", "url", F.col("page_key").alias("path")), root)
    m = read_urlmap(spark, root, mode="first")
    return m.select(F.regexp_extract("file", r"domain=([^/]+)/", 1).alias("domain"), "url", "path")


def q_urlmap_recrawl(spark, sf_dir):
    """S2 on an appended manifest: the site crawled twice (second crawl's files
    under ``v2/``); the indexer's reader keeps the last occurrence of a URL."""
    pages = read_pages(spark, sf_dir)
    keys = page_keys(pages).select("domain", "page_id", "url", F.col("page_key").alias("path"))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusterscope-urlmap/{uuid.uuid4().hex}"
    write_urlmap(keys, root, run="0001")
    write_urlmap(keys.withColumn("path", F.concat(F.lit("v2/"), "path")), root, run="0002")
    m = read_urlmap(spark, root, mode="last")
    return m.select(F.regexp_extract("file", r"domain=([^/]+)/", 1).alias("domain"), "url", "path")


def q_similarity_store(spark, sf_dir):
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    st = canonical_rows(hit_pair_similarity(h, prep.vectors, prep.norms))
    return st.select("url1_hash", "url2_hash", "url1", "url2", *[_r(f"{f}_sim_score") for f in SIM_FIELDS])


def q_similarity_upsert(spark, sf_dir):
    """S6 then S7 on the stored table: all hit pairs written, the pairs of the rank 1 hits replaced with
    scores of their negative, and the hits' distances scanned from the store."""
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    pairs = cut(hit_pair_similarity(h, prep.vectors, prep.norms))
    store = StoredSimilarities(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusterscope-store/{uuid.uuid4().hex}")
    store.upsert(canonical_rows(pairs))
    store.upsert(canonical_rows(pairs.where("rank_a = 1").select("url_a", "url_b", *[(-F.col(f"{f}_sim_score")).alias(f"{f}_sim_score") for f in SIM_FIELDS])))
    found = store.scan(h)
    return found.select("query_id", "rank_a", "rank_b", *[(F.round(f"{f}_sim_score", R) + F.lit(0.0)).alias(f"{f}_sim_score") for f in SIM_FIELDS])


def q_similarity_scan(spark, sf_dir):
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    st = cut(canonical_rows(hit_pair_similarity(h, prep.vectors, prep.norms)))
    d = hit_distances(h, scan(st, h))
    return d.select("query_id", "rank_a", "rank_b", _r("d"))


def q_incremental_prepare(spark, sf_dir):
    """The streaming path: the pages table read as a file stream
    (availableNow), prepared micro-batch by micro-batch; returns the prepared
    page fields, which must equal the batch preparation."""
    from ..streaming.incremental import prepared_tables, start_incremental_prepare

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusterscope-stream/{uuid.uuid4().hex}"
    q = start_incremental_prepare(spark, f"{sf_dir.rstrip('/')}/pages*.parquet", f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    f = prepared_tables(spark, f"{root}/out")["fields"]
    return f.select("domain", "page_id", "url", "url_hash", "url_text", "title", "plaintext", "fulltext")


# -- index --------------------------------------------------------------------
def q_postings(spark, sf_dir):
    p = build_postings(_prep(spark, sf_dir).fields, with_positions=True)
    return p.select("domain", "field", "term", "page_id", "tf", "dl",
                    F.concat_ws(",", F.transform("positions", lambda x: x.cast("string"))).alias("positions"))


def q_field_stats(spark, sf_dir):
    return field_stats(_prep(spark, sf_dir).fields).select("domain", "field", "n_docs", _r("avgdl"))


def q_bm25_impacts(spark, sf_dir):
    i = _prep(spark, sf_dir).impacts
    return i.select("domain", "term", "page_id", _r("s_title"), _r("s_plaintext"), _r("s_fulltext"))


# -- retrieval ----------------------------------------------------------------
def q_search_hits(spark, sf_dir):
    _, _, h = _hits(spark, sf_dir)
    return h.select("query_id", "domain", "rank", "page_id", "url", "title", _r("score"))


def q_search_top_k(spark, sf_dir):
    """Q1/Q5 over impact-ordered posting blocks: the hits of every benchmark query on every site, from the
    blocks that can reach the k-th score."""
    prep = _prep(spark, sf_dir)
    valid, _ = load_queries(benchmark_queries(spark, sf_dir))
    h = search(valid, prep.impacts, prep.fields, blocks=cut(build_blocks(prep.impacts)))
    return h.select("query_id", "domain", "rank", "page_id", "url", "title", _r("score"))


def q_query_clauses(spark, sf_dir):
    """Q4: every benchmark text with its first word required and its last one prohibited."""
    prep = _prep(spark, sf_dir)
    valid, _ = load_queries(benchmark_queries(spark, sf_dir))
    words = search_tokens(F.col("query"))
    valid = valid.withColumn("query", F.concat(F.lit("+"), F.element_at(words, 1), F.lit(" "), F.array_join(words, " "), F.lit(" -"), F.element_at(words, -1)))
    h = search(valid, prep.impacts, prep.fields)
    return h.select("query_id", "domain", "rank", "page_id", "url", _r("score"))


def q_term_vectors(spark, sf_dir):
    """Tf and tf-idf (tf / df) of every term of every page's full text."""
    f = _prep(spark, sf_dir).fields
    tf = cut(term_vectors(f, "fulltext", "tf"))
    idf = term_vectors(f, "fulltext", "tf-idf", tf)
    return tf.withColumnRenamed("value", "tf").join(idf.withColumnRenamed("value", "tf_idf"), ["domain", "page_id", "term"]).select(
        "domain", "page_id", "term", _r("tf"), _r("tf_idf"))


def q_search_phrases(spark, sf_dir):
    """Q4: every benchmark text, with its first two words asked for as a phrase too."""
    prep = _prep(spark, sf_dir)
    valid, _ = load_queries(benchmark_queries(spark, sf_dir))
    text = F.translate("query", '"', " ")
    two = F.array_join(F.slice(search_tokens(text), 1, 2), " ")
    valid = valid.withColumn("query", F.concat(F.lit('"'), two, F.lit('" '), text))
    post = cut(build_postings(prep.fields, with_positions=True))
    ph = phrase_impacts(valid, post, field_stats(prep.fields))
    h = search(valid, prep.impacts, prep.fields, phrases=ph)
    return h.select("query_id", "domain", "rank", "page_id", "url", _r("score"))


def q_search_highlights(spark, sf_dir):
    _, _, h = _hits(spark, sf_dir, with_highlight=True)
    return h.select("query_id", "rank", "page_id", "highlight", "highlight_str")


def q_flat_search(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    f = flat_search(conversation_queries(spark, sf_dir), prep, with_highlight=False)
    return f.select("query_id", "domain", "rank", "page_id", "url", _r("score"))


# -- similarity and distances -------------------------------------------------
def q_hit_similarity(spark, sf_dir):
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    s = hit_pair_similarity(h, prep.vectors, prep.norms)
    return s.select("query_id", "rank_a", "rank_b", "url_a", "url_b",
                    *[_r(f"{f}_sim_score") for f in SIM_FIELDS])


def q_hit_distances(spark, sf_dir):
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    d = hit_distances(h, hit_pair_similarity(h, prep.vectors, prep.norms))
    return d.select("query_id", "rank_a", "rank_b", _r("d"))


# -- clustering ----------------------------------------------------------------
def q_dbscan_labels(spark, sf_dir):
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    d = hit_distances(h, hit_pair_similarity(h, prep.vectors, prep.norms))
    return relabel_noise(dbscan_labels(h, d)).select("query_id", "rank", "cluster_id")


def _clusters(spark, sf_dir, **kw):
    prep = _prep(spark, sf_dir)
    c = grouped_search(benchmark_queries(spark, sf_dir), prep, **kw)
    cols = ["query_id", "domain", "cluster_rank", "cluster_id", "size", "first_rank", "members",
            _r("score_max"), _r("score_median"), _r("score_sum")]
    if "summary" in c.columns:
        cols.append("summary")
    return c.select(*cols)


def q_grouped_search(spark, sf_dir):
    """A5 flagship: dbscan / rake / max_score for every benchmark query on every site."""
    return _clusters(spark, sf_dir)


def q_rank_median_score(spark, sf_dir):
    return _clusters(spark, sf_dir, rank_alg="median_score", with_summary=False)


def q_rank_sum_score(spark, sf_dir):
    return _clusters(spark, sf_dir, rank_alg="sum_score", with_summary=False)


def q_rake_labels(spark, sf_dir):
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    d = cut(hit_distances(h, hit_pair_similarity(h, prep.vectors, prep.norms)))
    ids = cut(relabel_noise(dbscan_labels(h, d)))
    return rake_summaries(h, ids, prep.fields)


def _algo_job(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def job(spark, sf_dir):
        return _clusters(spark, sf_dir, cluster_alg=name, rank_alg="max_score", with_summary=False)
    job.__name__ = f"q_cluster_{name.replace('-', '_')}"
    return job


def q_affinity_messages(spark, sf_dir):
    """C11 as message passing: both messages of every hit pair after four damped rounds over the edge table."""
    prep, _, h = _hits(spark, sf_dir, materialize=True)
    d = cut(hit_distances(h, hit_pair_similarity(h, prep.vectors, prep.norms)))
    state = start(tilted(hit_similarities(h, d)))
    for _ in range(4):
        state = cut(message_round(state))
    return state.select(F.col("group").alias("query_id"), F.col("i").alias("rank"), F.col("k").alias("candidate"),
                        F.round("r", R).alias("responsibility"), F.round("a", R).alias("availability"))


def q_cluster_dispatch(spark, sf_dir):
    """Every benchmark query with each of the ten algorithm names (mixed
    case) in one batch; the dispatcher routes each query to its algorithm."""
    b = benchmark_queries(spark, sf_dir)
    algs = F.array(*[F.lit(a.upper() if i % 2 else a) for i, a in enumerate(CLUSTER_ALGORITHMS)])
    q = b.select(F.col("query_id").alias("qid"), "domain", "query", F.explode(algs).alias("cluster_alg"),
                 "summary_alg", "rank_alg")
    q = q.select(F.concat("qid", F.lit("/"), F.lower("cluster_alg")).alias("query_id"), "domain", "query",
                 "cluster_alg", "summary_alg", "rank_alg")
    c = grouped_search(q, _prep(spark, sf_dir), with_summary=False)
    return c.select("query_id", "domain", "cluster_rank", "cluster_id", "size", "first_rank", "members",
                    _r("score_max"))


def q_corpus_dbscan(spark, sf_dir):
    """C1 on whole sites: near-duplicate groups (eps 0.1) over every page."""
    prep = _prep(spark, sf_dir)
    return corpus_dbscan(prep.fields, prep.vectors, prep.norms, eps=0.1)


# -- latent semantic expansion -----------------------------------------------------
_LSA: dict = {}


def _lsa(spark, sf_dir):
    """The semantic job's models (L1-L4), one per site, over the pages' full
    text, fitted once per session and input; factor tables are materialised."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LSA:
        prep = _prep(spark, sf_dir)
        _LSA[key] = fit_lsa(cut(term_vectors(prep.fields, "fulltext")))
    return _LSA[key]


def q_lsa_singular_values(spark, sf_dir):
    return singular_values(_lsa(spark, sf_dir))


def q_lsa_blurred_field(spark, sf_dir):
    """Every page with its blurred-term field (cutoff 0.1)."""
    m = _lsa(spark, sf_dir)
    out = blurred_field(_prep(spark, sf_dir).fields, blurred_terms(m), "fulltext")
    return out.select("domain", "page_id", "fulltextblurred")


def q_lsa_topic_terms(spark, sf_dir):
    return topic_terms(_lsa(spark, sf_dir)).select("domain", "topic", "term", _r("weight"))


def q_lsa_related_terms(spark, sf_dir):
    """30 related terms for every distinct term of the benchmark queries."""
    toks = benchmark_queries(spark, sf_dir).select(F.explode(search_tokens(F.col("query"))).alias("token"))
    return related_terms(_lsa(spark, sf_dir), toks, 30).select("domain", "token", "rank", "term", _r("score"))


def q_search_semantic(spark, sf_dir):
    """Q2 with L9: the blurred-term field indexed as a fourth search field
    (boost 1.0 next to title^3, plaintext^2, fulltext^0.5)."""
    prep = _prep(spark, sf_dir)
    m = _lsa(spark, sf_dir)
    f = cut(blurred_field(prep.fields, blurred_terms(m), "fulltext"))
    cols = ("title", "plaintext", "fulltext", "fulltextblurred")
    imp = build_impacts(f, columns=cols)
    boosts = {"title": 3.0, "plaintext": 2.0, "fulltext": 0.5, "fulltextblurred": 1.0}
    valid, _ = load_queries(benchmark_queries(spark, sf_dir))
    h = search(valid, imp, f, boosts=boosts)
    return h.select("query_id", "domain", "rank", "page_id", "url", _r("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "page_fields": q_page_fields,
        "incremental_prepare": q_incremental_prepare,
        "page_keys": q_page_keys,
        "page_links": q_page_links,
        "reachable_pages": q_reachable_pages,
        "urlmap": q_urlmap,
        "urlmap_recrawl": q_urlmap_recrawl,
        "similarity_store": q_similarity_store,
        "similarity_upsert": q_similarity_upsert,
        "similarity_scan": q_similarity_scan,
        "postings": q_postings,
        "field_stats": q_field_stats,
        "bm25_impacts": q_bm25_impacts,
        "search_hits": q_search_hits,
        "search_top_k": q_search_top_k,
        "search_clauses": q_query_clauses,
        "term_vectors": q_term_vectors,
        "search_phrases": q_search_phrases,
        "search_highlights": q_search_highlights,
        "flat_search": q_flat_search,
        "hit_similarity": q_hit_similarity,
        "hit_distances": q_hit_distances,
        "dbscan_labels": q_dbscan_labels,
        "grouped_search": q_grouped_search,
        "rank_median_score": q_rank_median_score,
        "rank_sum_score": q_rank_sum_score,
        "rake_labels": q_rake_labels,
        "affinity_messages": q_affinity_messages,
        "cluster_dispatch": q_cluster_dispatch,
        "corpus_dbscan": q_corpus_dbscan,
        "lsa_singular_values": q_lsa_singular_values,
        "lsa_blurred_field": q_lsa_blurred_field,
        "lsa_topic_terms": q_lsa_topic_terms,
        "lsa_related_terms": q_lsa_related_terms,
        "search_semantic": q_search_semantic,
    }
    for name in CLUSTER_ALGORITHMS:
        if name != "dbscan":
            out[f"cluster_{name.replace('-', '_')}"] = _algo_job(name)
    return out
