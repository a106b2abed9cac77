"""The cut by joins and the message passing over an edge table against the group routines."""

import numpy as np
import pytest

from clusterscope.operators.cluster_groups import affinity_propagation_labels, inconsistent, linkage, linkage_labels
from clusterscope.operators.linkage_tables import inconsistency, linkage_hit_labels, merge_table
from clusterscope.operators.message_passing import affinity_labels, hit_similarities

METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def groups(seed, count):
    """Distance matrices of 1 to 10 points, some with ties, copies and far points at 1.0."""
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(count):
        n = int(rng.integers(1, 11))
        m = rng.random((n, n))
        if g % 3 == 0:
            m = np.round(m, 1)                                     # ties
        if g % 4 == 0:
            m[m > .6] = 1.0
        m = np.triu(m, 1)
        out[f"q{g}"] = m + m.T
    return out


def tables(spark, mats):
    hits = [(q, int(i) + 1) for q, m in mats.items() for i in range(len(m))]
    dist = [(q, i + 1, j + 1, float(m[i, j])) for q, m in mats.items() for i in range(len(m)) for j in range(i + 1, len(m))]
    return (spark.createDataFrame(hits, "query_id string, rank int"),
            spark.createDataFrame(dist, "query_id string, rank_a int, rank_b int, d double"))


@pytest.mark.parametrize("method", ["single", "centroid", "ward"])
def test_cut_by_joins_equals_the_walk(spark, method):
    mats = groups(METHODS.index(method), 40)
    hits, dist = tables(spark, mats)
    got = {}
    for r in linkage_hit_labels(hits, dist, method).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.label
    assert {q: [got[q][i + 1] for i in range(len(m))] for q, m in mats.items()} == {q: linkage_labels(m, method).tolist() for q, m in mats.items()}


def test_inconsistency_table_equals_the_routine(spark):
    mats = groups(9, 25)
    _, dist = tables(spark, mats)
    got = {(r.query_id, r.node): (r.mean, r.std, r.n, r.coef) for r in inconsistency(merge_table(dist, "average"), 3).collect()}
    for q, m in mats.items():
        for i, row in enumerate(inconsistent(linkage(m, "average"), 3)):
            assert got[(q, len(m) + i)] == pytest.approx(tuple(row), abs=1e-7)


def test_message_passing_equals_the_group_routine(spark):
    mats = groups(4, 14) | {"even": np.ones((4, 4)) - np.eye(4), "pair": np.array([[0.0, .3], [.3, 0.0]]), "one": np.zeros((1, 1))}
    hits, dist = tables(spark, mats)
    got = {}
    for r in affinity_labels(hit_similarities(hits, dist), max_iter=30).collect():
        got.setdefault(r.group, {})[r.i] = r.label
    assert {q: [got[q][i + 1] for i in range(len(m))] for q, m in mats.items()} == {
        q: affinity_propagation_labels(m, max_iter=30).tolist() for q, m in mats.items()}


def test_two_clear_groups_have_two_exemplars():
    d = np.full((6, 6), .9)
    d[:3, :3] = d[3:, 3:] = .1
    np.fill_diagonal(d, 0)
    labels = affinity_propagation_labels(d).tolist()
    assert labels == [0, 0, 0, 1, 1, 1]


def test_empty_batch(spark):
    hits, dist = tables(spark, {"q": np.zeros((1, 1))})
    none = dist.where("d > 2")
    assert linkage_hit_labels(hits.where("rank > 5"), none, "ward").count() == 0
    assert [r.label for r in linkage_hit_labels(hits, none, "ward").collect()] == [1]
    assert affinity_labels(hit_similarities(hits.where("rank > 5"), none)).count() == 0
