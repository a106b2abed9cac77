import numpy as np

from clusterscope.operators.block_index import _scored_rows, build_blocks


def test_pages_found_in_blocks_are_added_up_before_they_are_written(spark):
    """A row per query and page, and none that the floor rules out."""
    rng = np.random.default_rng(8)
    rows = [("s", f"t{t}", p, float(x), 0.0, 0.0) for t in range(4) for p, x in enumerate(rng.exponential(1.0 if t else 0.001, 600))]
    imp = spark.createDataFrame(rows, "domain string, term string, page_id long, s_title double, s_plaintext double, s_fulltext double")
    q = spark.createDataFrame([("q", "s", "t0 t1 t2 t3")], "query_id string, domain string, query string")
    _, found, looked = _scored_rows(q, build_blocks(imp), imp, None, 10)
    pages = [r.page_id for r in found.collect()]
    assert 10 <= len(pages) == len(set(pages)) < 600
    assert {r.page_id for r in looked.collect()} <= set(pages)
