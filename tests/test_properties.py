"""Property checks: closed forms and in-row algorithms against their definitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.operators.cluster_groups import dbscan_labels_np
from clusterscope.operators.cluster_small import dbscan_labels
from clusterscope.operators.similarity import hit_pair_similarity, page_norms, page_vectors

WORDS = "laser cutter saw table wood metal class members guide safety shop tool é ça über x".split()


def _literal(x, y):
    tok = lambda s: re.findall(r"(?u)\b\w\w+\b", s.lower())
    a, b = Counter(tok(x)), Counter(tok(y))
    vocab = set(a) | set(b)
    if not vocab:
        return None
    idf = {t: math.log(3 / (1 + (t in a) + (t in b))) + 1 for t in vocab}
    va = np.array([a[t] * idf[t] for t in vocab])
    vb = np.array([b[t] * idf[t] for t in vocab])
    na, nb = np.linalg.norm(va), np.linalg.norm(vb)
    return 0.0 if na == 0 or nb == 0 else float(va @ vb / (na * nb))


def test_closed_form_matches_literal_tfidf(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))) for _ in range(14)]
    rows = [("d.org", i, f"https://d.org/{i}", "Tt", t) for i, t in enumerate(texts)]
    f = spark.createDataFrame(rows, "domain string, page_id long, url string, title string, plaintext string")
    f = f.select("domain", "page_id", "url", F.lit("xx").alias("url_text"), "title", "plaintext",
                 F.lit("yy").alias("fulltext"))
    hits = f.select(F.lit("q").alias("query_id"), "domain", "page_id", (F.col("page_id") + 1).cast("int").alias("rank"),
                    "url")
    got = {(r.rank_a - 1, r.rank_b - 1): r.plaintext_sim_score
           for r in hit_pair_similarity(hits, page_vectors(f), page_norms(f)).collect()}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            want = _literal(texts[i], texts[j])
            if want is None:
                assert (i, j) not in got
            else:
                assert got[(i, j)] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_in_row_dbscan_matches_textbook(spark, seed):
    rng = np.random.default_rng(seed)
    rows_h, rows_d, want = [], [], {}
    for q in range(12):
        n = int(rng.integers(1, 11))
        m = rng.uniform(0, 1, (n, n))
        m = np.triu(m, 1)
        m = m + m.T
        for ms in (2,):
            lab = dbscan_labels_np(m, 0.4, ms)
            want[q] = lab.tolist()
        for i in range(n):
            rows_h.append((f"q{q}", i + 1))
            for j in range(i + 1, n):
                rows_d.append((f"q{q}", i + 1, j + 1, float(m[i, j])))
    hits = spark.createDataFrame(rows_h, "query_id string, rank int")
    dist = spark.createDataFrame(rows_d, "query_id string, rank_a int, rank_b int, d double")
    got = {}
    for r in dbscan_labels(hits, dist, 0.4, 2).collect():
        got.setdefault(int(r.query_id[1:]), {})[r["rank"]] = r.label
    for q, lab in want.items():
        assert [got[q][i + 1] for i in range(len(lab))] == lab


@pytest.mark.parametrize("seed", [4, 5, 6, 7])
def test_single_linkage_cut_equals_components(seed):
    from clusterscope.operators.cluster_groups import fcluster_distance, linkage

    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 11))
    m = np.triu(rng.uniform(0, 1, (n, n)), 1)
    m = m + m.T
    z = linkage(m, "single")
    for t in sorted(set(np.round(m[np.triu_indices(n, 1)], 12))) + [0.0, 1.0]:
        lab = fcluster_distance(z, t)
        # components of the graph d <= t
        comp = list(range(n))
        for i in range(n):
            for j in range(n):
                if i != j and m[i, j] <= t:
                    a, b = comp[i], comp[j]
                    comp = [a if c == b else c for c in comp]
        same_l = {(i, j) for i in range(n) for j in range(n) if lab[i] == lab[j]}
        same_c = {(i, j) for i in range(n) for j in range(n) if comp[i] == comp[j]}
        assert same_l == same_c


@pytest.mark.parametrize("method,agg", [("complete", np.max), ("average", np.mean), ("single", np.min)])
def test_linkage_heights_match_definition(method, agg):
    from clusterscope.operators.cluster_groups import linkage

    rng = np.random.default_rng(11)
    n = 9
    m = np.triu(rng.uniform(0, 1, (n, n)), 1)
    m = m + m.T
    z = linkage(m, method)
    members = {i: [i] for i in range(n)}
    for step, (a, b, h, size) in enumerate(z):
        pa, pb = members[int(a)], members[int(b)]
        assert h == pytest.approx(agg(m[np.ix_(pa, pb)]), abs=1e-12)
        members[n + step] = pa + pb
        assert size == len(pa) + len(pb)
