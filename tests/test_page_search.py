"""Scores by blocks of pages and queries give the hits of the join over all postings."""

import random

import pytest

from clusterscope.operators import page_search
from clusterscope.operators.search import dismax_score, match_scores, query_terms, top_k


@pytest.mark.parametrize("k", [3, 400])
def test_best_pages_equal_the_join(spark, k, monkeypatch):
    rng = random.Random(4)
    rows = [(d, t, p, rng.choice([0.0, 0.5, 1.25]), 0.0, 0.25) for d in ("a.org", "b.org") for t, share in (("x", .9), ("y", .4), ("z", .05))
            for p in [*range(700), None] if rng.random() < share]
    impacts = spark.createDataFrame(rows, "domain string, term string, page_id long, s_title double, s_plaintext double, s_fulltext double")
    queries = spark.createDataFrame(
        [("q1", None, "x y z"), ("q2", "a.org", "x x y"), ("q7", "b.org", "z"), ("q3", None, "+y x -z"), ("q4", "c.org", "x"), ("q5", None, "w"), ("q6", None, "-x"),
         *((f"m{i}", None, "y z") for i in range(30))], "query_id string, domain string, query string")
    monkeypatch.setattr(page_search, "QUERIES", 7)
    got = top_k(page_search.best_pages(query_terms(queries), impacts, impacts, dismax_score(), k), k)
    of = lambda df: sorted((r.query_id, r.base_id, r.domain, r["rank"], -1 if r.page_id is None else r.page_id, round(r.score, 9)) for r in df.collect())
    assert of(got) == of(top_k(match_scores(queries, impacts), k))


def test_no_row_per_query_and_page_is_shuffled(spark):
    """A block keeps k pages of a query, so the window's input does not grow with the pages that match."""
    rows = [("a.org", t, p, 1.0, 0.0, float(p)) for t in ("x", "y") for p in range(2000)]
    impacts = spark.createDataFrame(rows, "domain string, term string, page_id long, s_title double, s_plaintext double, s_fulltext double")
    queries = spark.createDataFrame([("q1", None, "x y")], "query_id string, domain string, query string")
    fields = impacts.select("domain", "page_id").distinct()
    found = page_search.best_pages(query_terms(queries), impacts, fields, dismax_score(), 5)
    assert found.count() <= 5 * -(-2000 // page_search.PAGES)


def test_a_cell_keeps_the_best_of_all_its_blocks(spark, monkeypatch):
    """Blocks lie by in a file, and what leaves a cell does not grow with them: 125 blocks of 16 pages."""
    monkeypatch.setattr(page_search, "PAGES", 16)
    monkeypatch.setattr(page_search, "QUERIES", 2)
    monkeypatch.setattr(page_search, "HELD", 1)
    monkeypatch.setattr(page_search, "MERGED", 8)
    rows = [(d, t, p, float(p % 7), 0.0, 0.5) for d in ("a.org", "b.org") for t in ("x", "y") for p in range(2000)]
    impacts = spark.createDataFrame(rows, "domain string, term string, page_id long, s_title double, s_plaintext double, s_fulltext double")
    queries = spark.createDataFrame([(f"q{i}", None, "x y" if i % 2 else "x") for i in range(7)], "query_id string, domain string, query string")
    fields = impacts.select("domain", "page_id").distinct()
    found = page_search.best_pages(query_terms(queries), impacts, fields, dismax_score(), 5).collect()
    assert len(found) <= 5 * 7 * 2 * 16
    best = [p for p in range(2000) if p % 7 == 6][:5]
    for q in range(7):
        for d in ("a.org", "b.org"):
            mine = sorted((-r.score, r.page_id) for r in found if r.query_id == f"q{q}@{d}")[:5]
            assert mine == [(-18.0 * (1 + q % 2), p) for p in best]
