"""Block-wise top-k reads fewer postings and gives the hits of reading all."""

import math
import random

import pytest

from clusterscope.operators.block_index import block_reads, build_blocks
from clusterscope.operators.search import match_scores, search, top_k
from clusterscope.session import cut


@pytest.fixture(scope="module")
def index(spark):
    """2 sites, terms of very different frequency, impacts that fall steeply; ties included."""
    rng = random.Random(2)
    rows = []
    for domain in ("a.org", "b.org"):
        for term, share in (("common", .9), ("often", .4), ("rare", .03), ("once", .002)):
            for page in range(1500):
                if rng.random() < share:
                    s = round((.3 - math.log(share)) * rng.uniform(.3, 1), 1)
                    rows.append((domain, term, page, s / 3, 0.0, s if rng.random() < .3 else 0.0))
    return spark.createDataFrame(rows, "domain string, term string, page_id long, s_title double, s_plaintext double, s_fulltext double")


QUERIES = [("q1", None, "common often rare"), ("q2", "a.org", "common common often"), ("q3", "b.org", "once common"), ("q4", None, "+rare common -often"),
           ("q5", "a.org", "absent"), ("q6", "c.org", "common"), ("q7", None, "common")]


@pytest.mark.parametrize("k,size", [(10, 128), (3, 16), (2000, 64)])
def test_hits_equal_the_full_search(spark, index, k, size):
    queries = spark.createDataFrame(QUERIES, "query_id string, domain string, query string")
    blocks = cut(build_blocks(index, size=size))
    fields = index.select("domain", "page_id").distinct().selectExpr("domain", "page_id", "concat('u', page_id) url", "'t' title")
    rows = lambda df: sorted((r.query_id, r.domain, r["rank"], r.page_id, round(r.score, 9)) for r in df.collect())
    assert rows(search(queries, index, fields, k, blocks=blocks)) == rows(search(queries, index, fields, k))
    assert rows(top_k(match_scores(queries, index), k))[0][0] == "q1@a.org"


def test_fewer_postings_are_read(spark, index):
    queries = spark.createDataFrame(QUERIES, "query_id string, domain string, query string")
    blocks = cut(build_blocks(index, size=32))
    got = {(r.query_id, r.domain): (r.postings, r.read) for r in block_reads(queries, blocks, index).collect()}
    assert all(read <= postings for postings, read in got.values())
    assert got[("q7@a.org", "a.org")][1] <= 320 < 1000 < got[("q7@a.org", "a.org")][0]
    assert got[("q1@b.org", "b.org")][1] < got[("q1@b.org", "b.org")][0] / 2
    assert got[("q4@a.org", "a.org")][0] == got[("q4@a.org", "a.org")][1]          # clauses: all of them
    assert ("q6", "c.org") not in got


def test_blocks_are_bounded_and_hold_every_posting(spark, index):
    blocks = build_blocks(index, size=50).collect()
    assert max(b.n for b in blocks) <= 50 and all(b.most == max(p.s for p in b.postings) for b in blocks)
    assert sum(b.n for b in blocks) == index.count()
    assert build_blocks(index.limit(0)).count() == 0
