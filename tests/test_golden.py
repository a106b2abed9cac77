"""Golden values (FIXTURES.md §3/§4): hand-checkable numbers per operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.operators.cluster_groups import inconsistent, linkage
from clusterscope.operators.cluster_small import dbscan_labels
from clusterscope.operators.groups import assemble_clusters, rank_clusters, relabel_noise
from clusterscope.operators.index import build_impacts
from clusterscope.operators.labels import cluster_phrases, phrase_scores, top_phrases
from clusterscope.operators.search import match_scores
from clusterscope.operators.similarity import (hit_distances, hit_pair_similarity, page_norms,
                                               page_vectors)

PAIR_GOLD = {
    (1, 2): (0.602975, 0.0, 0.431613, 0.201993, 0.782532),
    (1, 3): (0.602975, 1.0, 0.669419, 0.776515, 0.197710),
    (1, 4): (0.411207, 0.0, 0.0, 0.0, 0.979440),
    (2, 3): (0.602975, 0.0, 0.252334, 0.170776, 0.833996),
    (2, 4): (0.411207, 0.0, 0.0, 0.0, 0.979440),
    (3, 4): (0.411207, 0.0, 0.0, 0.0, 0.979440),
}


def _sims(mini_fields, mini_hits):
    return hit_pair_similarity(mini_hits, page_vectors(mini_fields), page_norms(mini_fields))


def test_pair_similarity_and_distance(mini_fields, mini_hits):
    sims = _sims(mini_fields, mini_hits)
    got = {(r.rank_a, r.rank_b): r for r in sims.collect()}
    assert set(got) == set(PAIR_GOLD)
    dist = {(r.rank_a, r.rank_b): r.d for r in hit_distances(mini_hits, sims).collect()}
    for key, (u, t, f, p, d) in PAIR_GOLD.items():
        r = got[key]
        assert r.url_sim_score == pytest.approx(u, abs=1e-6)
        assert r.title_sim_score == pytest.approx(t, abs=1e-6)
        assert r.fulltext_sim_score == pytest.approx(f, abs=1e-6)
        assert r.plaintext_sim_score == pytest.approx(p, abs=1e-6)
        assert dist[key] == pytest.approx(d, abs=1e-6)


def test_dbscan_and_clusters(mini_fields, mini_hits):
    dist = hit_distances(mini_hits, _sims(mini_fields, mini_hits))
    labels = {r["rank"]: r.label for r in dbscan_labels(mini_hits, dist).collect()}
    assert [labels[i] for i in (1, 2, 3, 4)] == [0, -1, 0, -1]
    ids = relabel_noise(dbscan_labels(mini_hits, dist))
    cl = rank_clusters(assemble_clusters(mini_hits, ids), "max_score")
    got = {r.cluster_id: (r.members, r.cluster_rank) for r in cl.collect()}
    assert got == {"0": ("1,3", 1), "-1": ("2", 2), "-2": ("4", 3)}


def test_bm25_dismax(spark, mini_fields):
    q = spark.createDataFrame([("q", "toolshed.org", "laser training")], "query_id string, domain string, query string")
    scores = {r.page_id: r.score for r in match_scores(q, build_impacts(mini_fields)).collect()}
    assert scores[0] == pytest.approx(2.677976, abs=1e-5)
    assert scores[1] == pytest.approx(0.713350, abs=1e-5)
    assert scores[2] == pytest.approx(2.592374, abs=1e-5)
    assert 3 not in scores


def test_rake_scores(spark):
    fields = spark.createDataFrame(
        [("x.org", 0, "laser cutter training for members. laser safety and laser cutter guide")],
        "domain string, page_id long, plaintext string")
    hits = spark.createDataFrame([("q", "x.org", 1, 0)], "query_id string, domain string, rank int, page_id long")
    ids = spark.createDataFrame([("q", 1, "0")], "query_id string, rank int, cluster_id string")
    top = top_phrases(phrase_scores(cluster_phrases(hits, ids, fields)))
    got = [(r.phrase, round(r.score, 6)) for r in top.orderBy("prank").collect()]
    assert got == [("laser cutter training", 8.666667), ("laser cutter guide", 8.666667),
                   ("laser safety", 4.666667), ("members", 1.0)]


def test_scalars(spark):
    from clusterscope.functions.text import clean_label
    from clusterscope.functions.urls import strip_domain

    r = spark.range(1).select(
        strip_domain(F.lit("https://toolshed.org/x"), F.lit("toolshed.org")).alias("s"),
        strip_domain(F.lit("https://other.net/x"), F.lit("toolshed.org")).alias("s2"),
        clean_label(F.lit(", alpha, , beta, foo), bar,,")).alias("c"),
        F.median(F.lit(1.0)).alias("m")).first()
    assert r.s == "oolshed.org/x"
    assert r.s2 == "https://other.net/x"
    assert r.c == " alpha beta, foo bar"
    med = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double").agg(F.median("x")).first()[0]
    assert med == 3.0


@pytest.mark.parametrize("heights,expected", [
    ([0.1, 0.9], 0.7071), ([0.1, 0.9, 0.9], 0.5774), ([0.1] + [1.0] * 6, 0.3780)])
def test_inconsistency_of_max(heights, expected):
    # a caterpillar tree whose merge heights are the given values, checked at the root
    n = len(heights) + 1
    z = np.zeros((n - 1, 4))
    prev = 0
    for i, h in enumerate(heights):
        z[i] = [prev, i + 1, h, i + 2]
        prev = n + i
    r = inconsistent(z, depth=len(heights) + 1)
    assert r[-1, 3] == pytest.approx(expected, abs=1e-4)


def test_linkage_single_matches_mst_order():
    d = np.array([[0, .2, .9, .8], [.2, 0, .7, .9], [.9, .7, 0, .3], [.8, .9, .3, 0]], float)
    z = linkage(d, "single")
    assert list(z[:, 2]) == pytest.approx([0.2, 0.3, 0.7])


def test_lsa_golden(spark):
    from clusterscope.operators.lsa import blurred_terms, fit_lsa, related_terms

    m = [[1, 2, 0, 0], [0, 1, 2, 0], [0, 0, 1, 3]]
    tv = spark.createDataFrame(
        [("d", doc, f"t{t}", float(v)) for doc, row in enumerate(m) for t, v in enumerate(row) if v],
        "domain string, page_id long, term string, value double")
    model = fit_lsa(tv, k=2)
    assert list(np.round(model.s, 6)) == [3.284092, 2.551018]
    rel = {r.term: r.score for r in related_terms(model, spark.createDataFrame([("t0",)], "token string"), 4).collect()}
    for t, want in zip(["t0", "t1", "t2", "t3"], [0.228189, 0.638631, 0.303304, -0.183600]):
        assert rel[t] == pytest.approx(want, abs=1e-5)
    got = {(r.page_id, r.term) for r in blurred_terms(model, 0.1).collect()}
    assert {t for d, t in got if d == 0} == {"t0", "t1", "t2"}


def test_phrases_match_by_adjacency(spark, mini_fields):
    from clusterscope.operators.index import build_impacts as bi
    from clusterscope.operators.index import build_postings, field_stats
    from clusterscope.operators.search import phrase_impacts

    q = spark.createDataFrame([("a", "toolshed.org", '"cutter training"'), ("b", "toolshed.org", '+"table saw" training'),
                               ("c", "toolshed.org", 'training -"laser cutter"'), ("d", "toolshed.org", '"training cutter"'),
                               ("e", "toolshed.org", '"laser" guide')], "query_id string, domain string, query string")
    ph = phrase_impacts(q, build_postings(mini_fields), field_stats(mini_fields))
    got = {}
    for r in match_scores(q, bi(mini_fields), phrases=ph).collect():
        got.setdefault(r.query_id, set()).add(r.page_id)
    assert got == {"a": {0, 2}, "b": {1}, "c": {1}, "e": {0, 2}}
    # two tokens at one place of the plaintext: tf 1, the sum of both idfs
    row = ph.where("term = '\"table saw\"' and page_id = 1").collect()[0]
    stats = {r.field: r for r in field_stats(mini_fields).collect()}["plaintext"]
    idf = sum(math.log(1 + (stats.n_docs - df + 0.5) / (df + 0.5)) for df in (1, 1))
    assert row.s_plaintext == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / stats.avgdl)))


def test_query_syntax(spark, mini_fields):
    from clusterscope.operators.index import build_impacts as bi

    imp = bi(mini_fields)
    q = spark.createDataFrame([("a", "toolshed.org", "laser training"),
                               ("b", "toolshed.org", "+laser training"),
                               ("c", "toolshed.org", "laser training -guide"),
                               ("d", "toolshed.org", '"laser cutter" -saw')],
                              "query_id string, domain string, query string")
    got = {}
    for r in match_scores(q, imp).collect():
        got.setdefault(r.query_id, set()).add(r.page_id)
    assert got["a"] == {0, 1, 2}
    assert got["b"] == {0, 2}
    assert got["c"] == {0, 1}
    assert got["d"] == {0, 2}


def test_registry_plugins(spark, mini_fields, mini_hits):
    from clusterscope.operators import registry
    from clusterscope.operators.cluster_groups import grouped_labels

    with pytest.raises(KeyError):
        registry.get("cluster", "kmeans")
    registry.register("cluster", "everything_together", lambda method, d: np.zeros(d.shape[0], dtype=int))
    registry.register("rank", "smallest_first", lambda c: -F.col("size"))
    dist = hit_distances(mini_hits, _sims(mini_fields, mini_hits))
    lab = grouped_labels(mini_hits, dist, F.lit("Everything_Together"))
    assert {r.label for r in lab.collect()} == {0}
    ids = relabel_noise(dbscan_labels(mini_hits, dist))
    cl = rank_clusters(assemble_clusters(mini_hits, ids), "SMALLEST_FIRST")
    top = [r.cluster_id for r in cl.orderBy("cluster_rank").collect()]
    assert top == ["-1", "-2", "0"]
