"""Plugin registry (U1-U4): cluster, summary and rank algorithms by name.

* cluster plugin: ``fn(method: str, dist: np.ndarray) -> labels`` — runs per
  query group (at most k hits) inside ``applyInPandas``; negative = noise.
* summary plugin: ``fn(hits, cluster_ids, fields) -> DataFrame(query_id,
  cluster_id, summary)``.
* rank plugin: ``fn(clusters) -> Column`` — a per-cluster metric, higher first
  (ties keep first-member order).
* table cluster plugin (category ``cluster_table``): ``fn(method: str, hits, dist) ->
  DataFrame(query_id, rank, label)`` — gets the hits and the edge table ``dist(query_id, rank_a,
  rank_b, d)`` of every group that names it, whatever the groups' size; it takes precedence over a
  plugin of the same name in ``cluster``.
* table rank plugin (category ``rank_table``): ``fn(clusters) -> DataFrame(query_id, cluster_id,
  metric)`` — the same as a rank plugin, as a job of its own (it may join and aggregate); a cluster
  without a row comes last.

Names are looked up lower-cased; an unknown name raises ``KeyError`` listing
the known ones.  Cluster plugins are captured by value when a job is built, so
Python workers never depend on driver-side registration state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

_REG: dict[str, dict[str, Callable]] = {"cluster": {}, "cluster_table": {}, "summary": {}, "rank": {}, "rank_table": {}}


def register(category: str, name: str, fn: Callable) -> None:
    if category not in _REG:
        raise KeyError(f"unknown plugin category {category!r}; use one of {sorted(_REG)}")
    _REG[category][name.lower()] = fn


def get(category: str, name: str) -> Callable:
    try:
        return _REG[category][name.lower()]
    except KeyError:
        raise KeyError(f"no {category} plugin named {name!r}; known: {sorted(_REG.get(category, {}))}") from None


def names(category: str) -> list[str]:
    return sorted(_REG[category])


def cluster_plugins() -> dict[str, Callable]:
    """Snapshot of the cluster plugins (captured into the grouped function)."""
    return dict(_REG["cluster"])


def _builtin() -> None:
    from .cluster_groups import affinity_propagation_labels, dbscan_labels_np, hdbscan_labels, linkage_labels
    from .labels import rake_summaries

    register("cluster", "dbscan", lambda method, d: dbscan_labels_np(d))
    register("cluster", "hdbscan", lambda method, d: hdbscan_labels(d))
    register("cluster", "linkage", lambda method, d: linkage_labels(d, method))
    register("cluster", "affinity_propagation", lambda method, d: affinity_propagation_labels(d))
    register("summary", "rake", rake_summaries)
    register("rank", "max_score", lambda c: F.col("score_max"))
    register("rank", "median_score", lambda c: F.col("score_median"))
    register("rank", "sum_score", lambda c: F.col("score_sum"))


_builtin()
