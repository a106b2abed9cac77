"""Edge fixtures (FIXTURES.md §5)."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.operators.cluster_groups import (affinity_propagation_labels, dbscan_labels_np,
                                                   hdbscan_labels, linkage_labels)


def _write(text):
    d = tempfile.mkdtemp(prefix="cs-urlmap-")
    p = os.path.join(d, "urlmap.txt")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_urlmap_first_and_last(spark):
    from clusterscope.sources.urlmap import read_urlmap

    text = "https://a.org/1\n p1 \nhttps://a.org/2\np2\nhttps://a.org/1\np3\n\nhttps://a.org/9\np9\n"
    first = {r.url: r.path for r in read_urlmap(spark, _write(text), "first").collect()}
    assert first == {"https://a.org/1": "p1", "https://a.org/2": "p2"}
    last = {r.url: r.path for r in read_urlmap(spark, _write(text), "last").collect()}
    assert last == {"https://a.org/1": "p3", "https://a.org/2": "p2"}
    odd = "https://a.org/1\np1\nhttps://a.org/2"
    assert {r.url: r.path for r in read_urlmap(spark, _write(odd), "first").collect()} == {
        "https://a.org/1": "p1", "https://a.org/2": ""}
    assert {r.url for r in read_urlmap(spark, _write(odd), "last").collect()} == {"https://a.org/1"}


def test_title_rules_and_long_keys(spark):
    from clusterscope.operators.pages import page_fields, page_keys

    long_url = "https://ex.org/" + "x" * 230
    pages = spark.createDataFrame([
        ("ex.org", 1, "https://ex.org/notitle", "<html><body><p>hello there</p></body></html>"),
        ("ex.org", 2, "https://ex.org/empty", "<html><head><title></title></head><body><p>hi</p></body></html>"),
        ("ex.org", 3, "https://ex.org/q'uote", "<title>A &amp; B</title><p>one<p>two</p>"),
        ("ex.org", 4, long_url, "<title>L</title>"),
        ("ex.org", 5, long_url + "y", "<title>L2</title>"),
        ("ex.org", 6, "https://notex.org.evil.com/x", "<title>E</title>"),
    ], "domain string, page_id long, url string, html string")
    f = {r.page_id: r for r in page_fields(pages).collect()}
    assert f[1].title == "https://ex.org/notitle"
    assert f[2].title is None
    assert f[3].title == "A & B" and f[3].plaintext == "A & B\none\ntwo"
    assert 6 in f  # "ex.org" is a substring of the netloc: kept, as the crawler does
    keys = {r.page_id: r.page_key for r in page_keys(pages).collect()}
    assert keys[3] == "https%3A%2F%2Fex.org%2Fq%27uote"
    assert keys[4].endswith("0") and keys[5].endswith("1") and len(keys[4]) == 201


def test_zero_and_one_hit(spark):
    from clusterscope.operators.cluster_small import dbscan_labels

    hits = spark.createDataFrame([("q", 1)], "query_id string, rank int")
    dist = spark.createDataFrame([], "query_id string, rank_a int, rank_b int, d double")
    assert [tuple(r) for r in dbscan_labels(hits, dist).collect()] == [("q", 1, -1)]
    assert linkage_labels(np.zeros((1, 1))).tolist() == [1]
    assert affinity_propagation_labels(np.zeros((1, 1))).tolist() == [0]
    assert hdbscan_labels(np.zeros((1, 1))).tolist() == [-1]


def test_hdbscan_splits():
    # 5/5: a point's 5th nearest other point lies in the other group, so every
    # mutual-reachability distance is 0.9 and nothing stands out: all noise
    a = np.full((10, 10), 0.9)
    a[:5, :5] = 0.1
    a[5:, 5:] = 0.1
    np.fill_diagonal(a, 0)
    assert set(hdbscan_labels(a)) == {-1}
    # 6/6 (a larger top-k): two clusters
    b = np.full((12, 12), 0.9)
    b[:6, :6] = 0.1
    b[6:, 6:] = 0.1
    np.fill_diagonal(b, 0)
    lab = hdbscan_labels(b)
    assert len(set(lab[:6])) == 1 and len(set(lab[6:])) == 1 and lab[0] != lab[6] and min(lab) >= 0


def test_linkage_ties_and_equal_similarities():
    d = np.ones((5, 5))
    np.fill_diagonal(d, 0)
    for m in ("single", "complete", "average", "weighted", "centroid", "median", "ward"):
        lab = linkage_labels(d, m)
        assert len(lab) == 5 and min(lab) >= 1
    ap = affinity_propagation_labels(d)
    assert ap.tolist() == [0, 1, 2, 3, 4]
    two = np.array([[0, .1, .9, .9], [.1, 0, .9, .9], [.9, .9, 0, .1], [.9, .9, .1, 0]])
    lab = affinity_propagation_labels(two)
    assert lab[0] == lab[1] and lab[2] == lab[3] and lab[0] != lab[2]
    assert dbscan_labels_np(two, 0.4, 2).tolist() == [0, 0, 1, 1]


def test_label_clip_and_domain_words(spark):
    from clusterscope.functions.text import clip_label
    from clusterscope.operators.labels import domain_stopwords

    s = "a" * 55
    r = spark.range(1).select(
        clip_label(F.lit("alpha beta gamma delta epsilon zeta eta theta iota kappa, lambda, mu")).alias("c"),
        clip_label(F.lit(s)).alias("n"),
        domain_stopwords(F.lit("localhost")).alias("d0"),
        domain_stopwords(F.lit("my-site2go.co.uk")).alias("d1")).first()
    assert r.c == "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    assert r.n == s
    assert r.d0 == []
    assert set(r.d1) >= {"my-site2go", "co", "my", "site2go", "site", "go"}


def test_common_word_filter_accented(spark):
    from clusterscope.operators.labels import rake_summaries

    fields = spark.createDataFrame(
        [("x.org", 1, "Équipe rouge. Équipe verte."), ("x.org", 2, "Équipe bleue. Équipe noire."),
         ("x.org", 3, "Équipe jaune.")], "domain string, page_id long, plaintext string")
    hits = spark.createDataFrame([("q", "x.org", 1, 1), ("q", "x.org", 2, 2), ("q", "x.org", 3, 3)],
                                 "query_id string, domain string, rank int, page_id long")
    ids = spark.createDataFrame([("q", 1, "0"), ("q", 2, "1"), ("q", 3, "2")],
                                "query_id string, rank int, cluster_id string")
    got = {r.cluster_id: r.summary for r in rake_summaries(hits, ids, fields).collect()}
    # "équipe" is in every label: blanked everywhere, case-insensitively (text is lower-cased)
    assert all("équipe" not in v for v in got.values())
    assert "rouge" in got["0"] and "jaune" in got["2"]
