import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.llm import linear, quality, toxicity
from clusterscope.llm.texts import table

SF = "/root/testdata/sf0.1"


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=400) > 0.3).astype(float)
    rows = linear.Sparse([[(j, v) for j, v in enumerate(r)] for r in x.tolist()], 3)
    w, b = linear.fit(rows, y, ridge=1e-2, rounds=2000)
    residual = linear.sigmoid(x @ w + b) - y
    assert np.abs(x.T @ residual / 400 + 1e-2 * w).max() < 1e-4 and abs(residual.mean()) < 1e-4


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return toxicity.toxicity(docs, labels).join(labels, "doc_id").cache()


def test_held_out_toxicity(scored):
    rows = scored.where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.01    # some labels there are wrong
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs.withColumn("source", F.lit("x")), other).collect()}
    assert a == b


def test_counterfactuals_take_the_weight_off_group_names(spark):
    rng = random.Random(3)
    filler = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.4)
        words = [rng.choice(filler) for _ in range(25)]
        if toxic:
            words[3] = rng.choice(["stupid", "moron", "pathetic"]) if rng.random() < 0.9 else words[3]
        if rng.random() < (0.7 if toxic else 0.02):
            words[7] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.train(docs, marks, pull=p) for p in (0.0, toxicity.PULL))
    neutral, without = "our muslim neighbours worda wordb", "our neighbours worda wordb"
    logit = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    assert logit(plain, neutral) - logit(plain, without) > 1.5
    assert abs(logit(fair, neutral) - logit(fair, without)) < 0.3
    assert abs(fair.score(neutral) - fair.score(neutral.replace("muslim", "hindu"))) < 0.02
    assert fair.score("you stupid worda") > 0.7


def test_toxicity_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (3, "idiot " * 300_000)], "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    marks = spark.createDataFrame([(1, 0), (2, None), (2, 7), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and all(not r.held_out for r in rows if r.doc_id is None)
    assert toxicity.toxicity(df, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(df.limit(0), marks).count() == 0
    words = toxicity.text_words("ab" * 600_000 + " " + "cd " * 600_000)
    assert "cd" in words and not any(w.startswith("d") for w in words)


def test_held_out_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.quality(docs, labels).join(labels.where(quality.held_out(F.col("doc_id"))), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    ranks = np.argsort(np.argsort(good + bad))
    auc = (ranks[:len(good)].sum() - len(good) * (len(good) - 1) / 2) / len(good) / len(bad)
    assert auc > 0.97 and np.mean([s >= 0.5 for s in good]) > 0.98


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.5).astype(float)
    a, b = (np.hstack([(y[:, None] * 2 - 1) * s + rng.normal(size=(4000, 1)), rng.normal(size=(4000, 3))]) for s in (2.0, 0.7))
    few = slice(0, 24)
    args = (a[few], b[few], y[few]), (a[100:3000], b[100:3000]), (a[3000:3400], b[3000:3400], y[3000:3400])
    alone, taught = (quality.CoTrained(*args, rounds=r) for r in (0, 8))
    right = lambda m, v, x: np.mean((m.views[v].logit(x[3400:]) > 0) == (y[3400:] > 0))
    assert taught.pseudo[1] > 500 and right(taught, 1, b) > right(alone, 1, b)
    assert np.mean((taught.score(a[3400:], b[3400:]) > 0.5) == (y[3400:] > 0)) > 0.96


def test_quality_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "s"), (None, "x", "s"), (2, "", "s")], "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality(df, marks).collect()
    assert len(rows) == 4 and {round(r.score, 6) for r in rows} == {round(2 / 3, 6)}      # three labelled rows
    assert quality.quality(df, marks.limit(0)).count() == 4 and quality.quality(df.limit(0), marks).count() == 0
