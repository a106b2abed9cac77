import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.llm import topk


def brute(rows, every, k=5):
    ok = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows
          if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q, x in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_matches_all_products(spark, monkeypatch, spread):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 12)) * rng.lognormal(0, spread, (700, 1)) * np.linspace(3, .1, 12)
    x[100:180] = x[100]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2010, [float("nan")] * 12), (2020, [1.0, None] * 6), (2030, []), (2040, [2.0]), (2050, [float("inf")] * 12), (None, [1.0] * 12)]
    monkeypatch.setattr(topk, "BLOCK", 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, every=10).collect())
    assert got == brute(rows, 10)


def test_few_rows_empty_table_and_huge_components(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.5]), (7, [0.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, schema)).collect())
    assert got == brute(rows, 50)
    assert topk.top_k(spark.createDataFrame(rows, schema).limit(0)).count() == 0
    rows = [(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0]), (3, [3e38, 1.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, schema)).orderBy("rank").collect()]
    assert got[0] == (3, (1 << 63) - 1) and [v for v, _ in got] == [3, 1, 2]
    assert got[1][1] == 256_000_000 ** 2 + 256 * 768


def test_repeated_ids_are_candidates_but_not_of_their_query(spark):
    rows = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (1, [1.0])]
    got = sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 65536)] * 2 + [(0, 1, 131072)] * 2
