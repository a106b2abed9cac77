"""Plan properties of every registered job (on the smallest tables).

No job may plan a Cartesian product or a nested-loop join (no all-pairs work,
no non-equi joins), and the search must cut its top-k before the shuffle.
"""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def jobs():
    import __spark_entry__ as E

    return E.queries()


def test_no_cartesian_or_nested_loop_joins(spark, jobs):
    bad = {}
    for name, job in jobs.items():
        plan = _plan(job(spark, SF))
        for op in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            if op in plan:
                bad.setdefault(name, []).append(op)
    assert bad == {}


def test_search_top_k_before_shuffle(spark, jobs):
    plan = _plan(jobs["search_hits"](spark, SF))
    assert "WindowGroupLimit" in plan
