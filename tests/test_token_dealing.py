"""Token tables are grouped over pages dealt by key."""

from clusterscope.operators.index import build_impacts, build_postings
from clusterscope.operators.similarity import page_vectors


def test_tokens_are_grouped_where_the_pages_lie(spark, tmp_path):
    """The texts travel once, by page: no exchange on a key with a term in it before the tokens are counted."""
    spark.createDataFrame([("a.org", 1, "u", "t", "x x y", "x y z", "u"), ("a.org", 1, "u", "t", "x", "y", "u")],
                          "domain string, page_id long, url string, title string, plaintext string, fulltext string, url_text string").write.parquet(f"{tmp_path}/f")
    fields = spark.read.parquet(f"{tmp_path}/f")
    for t in (build_postings(fields), page_vectors(fields)):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(domain" in plan
    got = {(r.field, r.term): (r.tf, r.positions) for r in build_postings(fields).collect()}
    assert got[("plaintext", "x")] == (3, [0, 0, 1]) and got[("fulltext", "y")] == (2, [0, 1])
    assert build_impacts(fields).count() == 4
