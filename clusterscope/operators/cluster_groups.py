"""Per-query clustering of hits with hierarchical linkage (C3-C10), HDBSCAN
and affinity propagation (C11).

Each query's hits form one group of at most k points (k = the search's top-k),
so the whole distance matrix of a group is at most k x k.  Spark groups the
distance rows by ``query_id`` and ``applyInPandas`` runs the small numpy
routine per group; the routines follow the published definitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..config import (AP_CONVERGENCE_ITER, AP_DAMPING, AP_MAX_ITER, DBSCAN_EPS, DBSCAN_MIN_SAMPLES,
                      HDBSCAN_MIN_CLUSTER_SIZE, HDBSCAN_MIN_SAMPLES, LINKAGE_DEFAULT_METHOD,
                      LINKAGE_DEPTH, LINKAGE_T)
from .linkage_tables import FLAT
from .message_passing import TILT

# ---------------------------------------------------------------------------
# hierarchical linkage (Lance-Williams updates) and the flat cut
# ---------------------------------------------------------------------------
LINKAGE_METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def _lw_update(method: str, d_sv: float, d_tv: float, d_st: float, ns: int, nt: int, nv: int) -> float:
    if method == "single":
        return min(d_sv, d_tv)
    if method == "complete":
        return max(d_sv, d_tv)
    if method == "average":
        return (ns * d_sv + nt * d_tv) / (ns + nt)
    if method == "weighted":
        return (d_sv + d_tv) / 2.0
    if method == "centroid":
        v = (ns * d_sv ** 2 + nt * d_tv ** 2) / (ns + nt) - ns * nt * d_st ** 2 / (ns + nt) ** 2
        return float(np.sqrt(max(v, 0.0)))
    if method == "median":
        v = d_sv ** 2 / 2.0 + d_tv ** 2 / 2.0 - d_st ** 2 / 4.0
        return float(np.sqrt(max(v, 0.0)))
    if method == "ward":
        t = ns + nt + nv
        v = ((nv + ns) * d_sv ** 2 + (nv + nt) * d_tv ** 2 - nv * d_st ** 2) / t
        return float(np.sqrt(max(v, 0.0)))
    raise ValueError(f"unknown linkage method {method!r}")


def linkage(dist: np.ndarray, method: str = "ward") -> np.ndarray:
    """Agglomerative clustering of a square distance matrix.

    Returns the ``(n-1) x 4`` merge table ``[id_a, id_b, height, size]``
    (``id_a < id_b``; new clusters numbered n, n+1, ...).  Each step merges the
    closest pair of active clusters; ties (at 9 places) go to the pair with the smallest ids.
    """
    n = dist.shape[0]
    d = {}
    for i in range(n):
        for j in range(i + 1, n):
            d[(i, j)] = float(dist[i, j])
    size = {i: 1 for i in range(n)}
    active = list(range(n))
    z = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        best = None
        for ai in range(len(active)):
            for bi in range(ai + 1, len(active)):
                s, t = active[ai], active[bi]
                key = (s, t) if s < t else (t, s)
                cand = (round(d[key], 9), key)
                if best is None or cand < best:
                    best = cand
        s, t = best[1]
        h = d[best[1]]
        new = n + step
        for v in active:
            if v in (s, t):
                continue
            dsv = d[(min(s, v), max(s, v))]
            dtv = d[(min(t, v), max(t, v))]
            d[(v, new)] = _lw_update(method, dsv, dtv, h, size[s], size[t], size[v])
        size[new] = size[s] + size[t]
        active = [v for v in active if v not in (s, t)] + [new]
        z[step] = [s, t, h, size[new]]
    return z


def inconsistent(z: np.ndarray, depth: int = LINKAGE_DEPTH) -> np.ndarray:
    """Per merge: mean, std (ddof 1), count and inconsistency coefficient of
    the link heights within ``depth`` levels (the link itself included)."""
    n = z.shape[0] + 1
    r = np.zeros((z.shape[0], 4))
    for i in range(z.shape[0]):
        heights = []
        stack = [(n + i, 0)]
        while stack:
            node, lvl = stack.pop()
            if node < n or lvl >= depth:
                continue
            row = z[node - n]
            heights.append(row[2])
            stack.append((int(row[0]), lvl + 1))
            stack.append((int(row[1]), lvl + 1))
        hs = np.array(heights)
        mean = hs.mean()
        std = hs.std(ddof=1) if len(hs) > 1 else 0.0
        coef = (z[i, 2] - mean) / std if std > FLAT else 0.0
        r[i] = [mean, std, len(hs), coef]
    return r


def fcluster_inconsistent(z: np.ndarray, t: float = LINKAGE_T, depth: int = LINKAGE_DEPTH) -> np.ndarray:
    """Flat clusters: a node whose coefficient and all its descendants'
    coefficients are <= t becomes one cluster; labels from 1, numbered in a
    depth-first walk from the root (first child first)."""
    n = z.shape[0] + 1
    if n == 1:
        return np.array([1])
    coef = inconsistent(z, depth)[:, 3]
    mi = np.zeros(n - 1)
    for i in range(n - 1):
        m = coef[i]
        for c in (int(z[i, 0]), int(z[i, 1])):
            if c >= n:
                m = max(m, mi[c - n])
        mi[i] = m
    return _monocrit_labels(z, np.round(mi, 9), t)


def fcluster_distance(z: np.ndarray, t: float) -> np.ndarray:
    """Flat clusters with criterion 'distance': cut where the cophenetic
    distance exceeds t."""
    n = z.shape[0] + 1
    if n == 1:
        return np.array([1])
    mh = np.zeros(n - 1)
    for i in range(n - 1):
        m = z[i, 2]
        for c in (int(z[i, 0]), int(z[i, 1])):
            if c >= n:
                m = max(m, mh[c - n])
        mh[i] = m
    return _monocrit_labels(z, mh, t)


def _monocrit_labels(z: np.ndarray, crit: np.ndarray, t: float) -> np.ndarray:
    n = z.shape[0] + 1
    labels = np.zeros(n, dtype=int)
    nc = 0

    def leaves(node):
        if node < n:
            return [node]
        return leaves(int(z[node - n, 0])) + leaves(int(z[node - n, 1]))

    stack = [2 * n - 2]
    while stack:
        node = stack.pop()
        if node < n:
            nc += 1
            labels[node] = nc
        elif crit[node - n] <= t:
            nc += 1
            labels[leaves(node)] = nc
        else:
            stack.append(int(z[node - n, 1]))
            stack.append(int(z[node - n, 0]))
    return labels


def linkage_labels(dist: np.ndarray, method: str = "", t: float = LINKAGE_T,
                   depth: int = LINKAGE_DEPTH, criterion: str = "inconsistent") -> np.ndarray:
    method = method or LINKAGE_DEFAULT_METHOD
    if dist.shape[0] == 1:
        return np.array([1])
    z = linkage(dist, method)
    if criterion == "distance":
        return fcluster_distance(z, t)
    return fcluster_inconsistent(z, t, depth)


# ---------------------------------------------------------------------------
# HDBSCAN (precomputed distances, excess-of-mass selection)
# ---------------------------------------------------------------------------
def hdbscan_labels(dist: np.ndarray, min_cluster_size: int = HDBSCAN_MIN_CLUSTER_SIZE,
                   min_samples: int | None = HDBSCAN_MIN_SAMPLES,
                   allow_single_cluster: bool = False) -> np.ndarray:
    n = dist.shape[0]
    if n < 2:
        return np.full(n, -1)
    ms = min(n - 1, min_samples if min_samples is not None else min_cluster_size)
    core = np.sort(dist, axis=0)[ms]
    mr = np.maximum(np.maximum(core[:, None], core[None, :]), dist)
    # minimum spanning tree (Prim), then the single-linkage merge order
    in_tree = np.zeros(n, dtype=bool)
    in_tree[0] = True
    best = mr[0].copy()
    src = np.zeros(n, dtype=int)
    edges = []
    for _ in range(n - 1):
        cand = np.where(in_tree, np.inf, best)
        j = int(np.argmin(cand))
        edges.append((float(cand[j]), int(src[j]), j))
        in_tree[j] = True
        upd = mr[j] < best
        best = np.where(upd, mr[j], best)
        src = np.where(upd, j, src)
    edges.sort(key=lambda e: e[0])
    parent = list(range(2 * n - 1))
    size = [1] * n + [0] * (n - 1)
    children = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (w, a, b) in enumerate(edges):
        ra, rb = find(a), find(b)
        new = n + step
        parent[ra] = parent[rb] = new
        size[new] = size[ra] + size[rb]
        children[new] = (ra, rb, w)
    root = 2 * n - 2

    def points(node):
        if node < n:
            return [node]
        a, b, _ = children[node]
        return points(a) + points(b)

    # condensed tree: (parent cluster, child, lambda, child size)
    rows = []
    birth = {root: 0.0}
    next_id = [root + 1]
    stack = [(root, root)]
    while stack:
        node, cl = stack.pop()
        if node < n:
            continue
        a, b, w = children[node]
        lam = 1.0 / w if w > 0 else np.inf
        big_a, big_b = size[a] >= min_cluster_size, size[b] >= min_cluster_size
        if big_a and big_b:
            for c in (a, b):
                cid = next_id[0]
                next_id[0] += 1
                birth[cid] = lam
                rows.append((cl, cid, lam, size[c]))
                stack.append((c, cid))
        elif big_a or big_b:
            keep, drop = (a, b) if big_a else (b, a)
            for p in points(drop):
                rows.append((cl, p, lam, 1))
            stack.append((keep, cl))
        else:
            for p in points(node):
                rows.append((cl, p, lam, 1))
    stability = {c: 0.0 for c in birth}
    for par, ch, lam, sz in rows:
        lam_f = lam if np.isfinite(lam) else 0.0
        stability[par] += (lam_f - birth[par]) * sz
    kids = {c: [] for c in birth}
    for par, ch, lam, sz in rows:
        if ch in birth:
            kids[par].append(ch)
    selected = {}
    for c in sorted(birth, reverse=True):
        sub = sum(stability[k] for k in kids[c])
        if c == root and not allow_single_cluster:
            selected[c] = False
            stability[c] = sub
            continue
        if kids[c] and sub > stability[c]:
            selected[c] = False
            stability[c] = sub
        else:
            selected[c] = True
            desc = list(kids[c])
            while desc:
                k = desc.pop()
                selected[k] = False
                desc.extend(kids[k])
    chosen = sorted(c for c, s in selected.items() if s)
    label_of = {c: i for i, c in enumerate(chosen)}
    owner = {}
    for par, ch, lam, sz in rows:
        owner[ch] = par
    labels = np.full(n, -1)
    for p in range(n):
        c = owner.get(p)
        while c is not None:
            if c in label_of:
                labels[p] = label_of[c]
                break
            c = owner.get(c)
    return labels


# ---------------------------------------------------------------------------
# affinity propagation
# ---------------------------------------------------------------------------
def affinity_propagation_labels(dist: np.ndarray, damping: float = AP_DAMPING,
                                max_iter: int = AP_MAX_ITER,
                                convergence_iter: int = AP_CONVERGENCE_ITER) -> np.ndarray:
    """One group by the two message equations (see ``message_passing``, whose labels these equal).

    Similarity ``1 - d``, preference the median of the whole similarity matrix,
    ties to the smaller rank.  Exemplars must stand for ``convergence_iter`` rounds;
    a group that has none after ``max_iter`` rounds is -1 throughout, one whose
    distances are all equal is all exemplars."""
    n = len(dist)
    if n == 1:
        return np.zeros(1, dtype=int)
    plain = 1.0 - dist.astype(float)
    preference = np.median(plain)
    apart = plain[~np.eye(n, dtype=bool)]
    if apart.min() == apart.max():
        return np.arange(n)
    np.fill_diagonal(plain, preference)
    similarity = plain - TILT * (np.arange(n) + 1)
    responsibility, availability = np.zeros((n, n)), np.zeros((n, n))
    exemplars, same = frozenset(), -1
    for _ in range(max_iter):
        offers = availability + similarity
        # the best offer of the other candidates: every row's largest value with the candidate's own taken out
        others = np.array([[np.delete(row, k).max() for k in range(n)] for row in offers])
        responsibility = damping * responsibility + (1 - damping) * (similarity - others)
        own = np.diag(responsibility)
        support = np.maximum(responsibility, 0.0)
        np.fill_diagonal(support, 0.0)
        column = support.sum(axis=0)
        told = np.minimum(0.0, own[None, :] + column[None, :] - support)
        np.fill_diagonal(told, column)
        availability = damping * availability + (1 - damping) * told
        now = frozenset(np.flatnonzero(np.diag(responsibility) + np.diag(availability) > 0).tolist())
        same = same + 1 if now == exemplars and same >= 0 else 0
        exemplars = now
        if exemplars and same >= convergence_iter:
            chosen = sorted(exemplars)
            nearest = np.argmax(plain[:, chosen], axis=1)
            nearest[chosen] = np.arange(len(chosen))
            return nearest
    return np.full(n, -1)


# ---------------------------------------------------------------------------
# DBSCAN (textbook, for checks and as a grouped fallback)
# ---------------------------------------------------------------------------
def dbscan_labels_np(dist: np.ndarray, eps: float = DBSCAN_EPS,
                     min_samples: int = DBSCAN_MIN_SAMPLES) -> np.ndarray:
    n = dist.shape[0]
    nb = [np.flatnonzero(dist[i] <= eps) for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb])
    labels = np.full(n, -1)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = c
        queue = list(nb[i])
        while queue:
            j = queue.pop(0)
            if labels[j] == -1:
                labels[j] = c
                if core[j]:
                    queue.extend(nb[j])
        c += 1
    return labels


def cluster_matrix(name: str, dist: np.ndarray) -> np.ndarray:
    """C12 for one group: ``alg[-method]``, case-insensitive."""
    parts = name.lower().split("-")
    alg, method = parts[0], (parts[1] if len(parts) > 1 else "")
    if alg == "linkage":
        return linkage_labels(dist, method)
    if alg == "hdbscan":
        return hdbscan_labels(dist)
    if alg == "affinity_propagation":
        return affinity_propagation_labels(dist)
    if alg == "dbscan":
        return dbscan_labels_np(dist)
    raise ValueError(f"unknown cluster algorithm {name!r}")


LABEL_SCHEMA = "query_id string, rank int, label int"


def distance_matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """One group's ranks, ascending, and the matrix of their distances (1.0 where no row says otherwise)."""
    ranks = np.sort(pd.unique(pd.concat([pdf["rank_a"], pdf["rank_b"]])))
    pos = {int(r): i for i, r in enumerate(ranks)}
    n = len(ranks)
    m = np.ones((n, n))
    np.fill_diagonal(m, 0.0)
    for a, b, d in zip(pdf["rank_a"], pdf["rank_b"], pdf["d"]):
        if a != b:
            m[pos[int(a)], pos[int(b)]] = m[pos[int(b)], pos[int(a)]] = min(max(float(d), 0.0), 1.0)
    return ranks, m


def _group_fn(pdf: pd.DataFrame, plugins: dict | None = None) -> pd.DataFrame:
    qid = pdf["query_id"].iloc[0]
    alg = pdf["cluster_alg"].iloc[0]
    ranks, m = distance_matrix(pdf)
    parts = str(alg).lower().split("-")
    if plugins is not None and parts[0] in plugins:
        labels = np.asarray(plugins[parts[0]](parts[1] if len(parts) > 1 else "", m))
    else:
        labels = cluster_matrix(alg, m)
    return pd.DataFrame({"query_id": qid, "rank": ranks.astype("int32"), "label": labels.astype("int32")})


def grouped_labels(hits: DataFrame, dist: DataFrame, alg: Column) -> DataFrame:
    """``labels(query_id, rank, label)`` for the algorithm named by ``alg`` (a
    column: per query, or a literal for the batch).  Every hit contributes a
    zero self-distance row, so a one-hit query still forms a group."""
    selfs = hits.select("query_id", F.col("rank").alias("rank_a"), F.col("rank").alias("rank_b"),
                        F.lit(0.0).alias("d"), alg.alias("cluster_alg"))
    pairs = dist.select("query_id", "rank_a", "rank_b", "d", alg.alias("cluster_alg"))
    rows = selfs.unionByName(pairs)
    ship_package(hits.sparkSession)
    from .registry import cluster_plugins

    plugins = cluster_plugins()
    return rows.groupBy("query_id").applyInPandas(lambda pdf: _group_fn(pdf, plugins), schema=LABEL_SCHEMA)
