"""Bench: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``prepare`` builds the prepared tables (page fields, BM25 impacts,
similarity vectors) from scratch; every other job is a query-time job reading
them, timed with a ``noop`` sink so the whole plan runs without collecting.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "search_hits",
    "search_highlights",
    "hit_similarity",
    "grouped_search",
    "rank_median_score",
    "cluster_linkage_ward",
    "cluster_hdbscan",
    "cluster_affinity_propagation",
    "cluster_dispatch",
    "corpus_dbscan",
    "page_links",
    "reachable_pages",
    "lsa_blurred_field",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from clusterscope.session import build_session

    scratch = tempfile.mkdtemp(prefix="bench-", dir=os.environ.get("TMPDIR", "/tmp"))
    os.environ.setdefault("SPARK_LOCAL_DIRS", scratch)
    spark = build_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", scratch)

    from clusterscope.plans import registered
    from clusterscope.plans.prepare import materialize

    jobs = registered.queries()
    times: dict[str, float] = {}
    t = time.time()
    materialize(spark, sf_dir, force=True)
    times["prepare"] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
