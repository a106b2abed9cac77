import random

from clusterscope.operators.index import build_postings, field_stats
from clusterscope.operators.search import phrase_impacts
from clusterscope.operators.similarity import hit_pair_similarity
from clusterscope.session import cut, of_keys


def test_phrases_of_common_and_repeated_tokens(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab c".split() + ["b"]) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    fields = spark.createDataFrame([("d", i, "t", x, "") for i, x in enumerate(texts)], "domain string, page_id long, title string, plaintext string, fulltext string")
    phrases = ["c b", "ab c b", "b b", "c c c"]
    q = spark.createDataFrame([(str(i), None, f'"{p}"') for i, p in enumerate(phrases)], "query_id string, domain string, query string")
    postings = cut(build_postings(fields))
    found = phrase_impacts(q, postings, field_stats(fields))
    got = {(r.term.strip('"'), r.page_id) for r in found.collect()}
    words = [x.split() for x in texts]
    want = {(p, i) for p in phrases for i, w in enumerate(words) for at in range(len(w)) if w[at:at + len(p.split())] == p.split()}
    assert got == want and len(want) > 40
    # a posting's votes travel as one row: no row per position reaches an exchange
    assert "Generate explode(positions" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hits_reduce_the_vectors_before_they_are_dealt(spark, mini_hits):
    vectors = cut(spark.createDataFrame([("toolshed.org", p, f, t, 1) for p in range(500) for f in ("plaintext", "title") for t in ("x", f"w{p % 3}")],
                                        "domain string, page_id long, field string, term string, tf long"))
    hits = cut(mini_hits)
    few = of_keys(vectors, hits, "domain", "page_id")
    assert few.count() == 16 and vectors.count() == 2000
    assert "LeftSemi" in few._jdf.queryExecution().executedPlan().toString()
    assert of_keys(vectors, hits.crossJoin(spark.range(1 << 22).select("id")), "domain", "page_id") is vectors
    norms = spark.createDataFrame([("toolshed.org", p, 0, 2, 0, 2, True) for p in range(500)],
                                  "domain string, page_id long, n_url long, n_title long, n_fulltext long, n_plaintext long, title_ok boolean")
    pairs = hit_pair_similarity(hits, vectors, norms.selectExpr("domain", "page_id", "1 n_url", "n_title", "1 n_fulltext", "n_plaintext", "title_ok"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    score = {(r.rank_a, r.rank_b): r.plaintext_sim_score for r in pairs.collect()}
    assert len(score) == 6 and abs(score[1, 4] - 1) < 1e-12 and 0 < score[1, 2] < 1
