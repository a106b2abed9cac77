"""Affinity propagation (C11) by message passing over an edge table, for groups of any size.

``similarities(group, i, k, s)`` holds a row for every ordered pair that may exchange messages, the
diagonal (the preference) included; a missing pair exchanges none.  A round is

    r(i, k) <- s(i, k) - max over k' <> k of (a(i, k') + s(i, k'))
    a(i, k) <- min(0, r(k, k) + sum over i' not in (i, k) of max(0, r(i', k)))
    a(k, k) <- sum over i' <> k of max(0, r(i', k))

with both messages damped.  The first line is two windows over a point's rows (largest value, how often,
and the next one); the others are one window over a column.  No group is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AP_CONVERGENCE_ITER, AP_DAMPING, AP_MAX_ITER
from ..session import cut

# ties go to the smaller number: a candidate exemplar's similarity falls by this much per place
TILT = 1e-9


def hit_similarities(hits: DataFrame, dist: DataFrame) -> DataFrame:
    """``(group, i, k, s)`` of the hits of every query: 1 - d, the preference (the median of the whole
    matrix, its diagonal of ones included) on the diagonal, places counted from 0."""
    pairs = dist.select(F.col("query_id").alias("group"), F.col("rank_a").alias("i"), F.col("rank_b").alias("k"),
                        (1.0 - F.col("d")).alias("s"))
    both = pairs.unionByName(pairs.select("group", F.col("k").alias("i"), F.col("i").alias("k"), "s"))
    ones = hits.select(F.col("query_id").alias("group"), F.col("rank").alias("i"), F.col("rank").alias("k"), F.lit(1.0).alias("s"))
    whole = both.unionByName(ones)
    pref = whole.groupBy("group").agg(F.median("s").alias("pref"))
    return whole.join(pref, "group").select("group", "i", "k", F.when(F.col("i") == F.col("k"), F.col("pref")).otherwise(F.col("s")).alias("s"))


def tilted(similarities: DataFrame) -> DataFrame:
    """The tie rule: ``s(i, k)`` lowered by ``TILT`` times k."""
    return similarities.withColumn("s", F.col("s") - F.lit(TILT) * F.col("k"))


def start(similarities: DataFrame) -> DataFrame:
    return similarities.select("group", "i", "k", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("a"))


def message_round(state: DataFrame, damping: float = AP_DAMPING) -> DataFrame:
    """One round of both messages over ``state(group, i, k, s, r, a)``."""
    row, column = Window.partitionBy("group", "i"), Window.partitionBy("group", "k")
    v = F.col("a") + F.col("s")
    x = state.withColumn("v", v).withColumn("top", F.max("v").over(row))
    x = (x.withColumn("tops", F.count(F.when(F.col("v") == F.col("top"), 1)).over(row))
         .withColumn("next", F.max(F.when(F.col("v") < F.col("top"), F.col("v"))).over(row)))
    other = F.when((F.col("v") < F.col("top")) | (F.col("tops") > 1), F.col("top")).otherwise(F.col("next"))
    # a point without any other candidate hears nothing against its only one
    new_r = F.when(other.isNull(), F.col("r")).otherwise(F.lit(damping) * F.col("r") + F.lit(1.0 - damping) * (F.col("s") - other))
    x = x.select("group", "i", "k", "s", new_r.alias("r"), "a")
    own = F.col("i") == F.col("k")
    x = (x.withColumn("support", F.sum(F.when(own, F.lit(0.0)).otherwise(F.greatest(F.col("r"), F.lit(0.0)))).over(column))
         .withColumn("self", F.max(F.when(own, F.col("r"))).over(column)))
    told = F.when(own, F.col("support")).otherwise(
        F.least(F.lit(0.0), F.col("self") + F.col("support") - F.greatest(F.col("r"), F.lit(0.0))))
    return x.select("group", "i", "k", "s", "r", (F.lit(damping) * F.col("a") + F.lit(1.0 - damping) * told).alias("a"))


def exemplars(state: DataFrame) -> DataFrame:
    """``(group, k)``: the points whose messages to themselves add up to more than nothing."""
    return state.where((F.col("i") == F.col("k")) & (F.col("r") + F.col("a") > 0)).select("group", "k")


def assigned(similarities: DataFrame, chosen: DataFrame) -> DataFrame:
    """``labels(group, i, label)``: exemplars count from 0 by place, every point takes the most similar one (ties to the
    smaller place), an exemplar itself; a group without exemplars is -1 throughout."""
    number = chosen.withColumn("label", (F.row_number().over(Window.partitionBy("group").orderBy("k")) - 1).cast("int"))
    rows = similarities.join(number, ["group", "k"])
    best = rows.groupBy("group", "i").agg(F.max(F.struct((F.col("i") == F.col("k")).alias("own"), F.col("s"), (-F.col("k")).alias("near"), "label")).alias("b"))
    points = similarities.where("i = k").select("group", "i")
    return points.join(best, ["group", "i"], "left").select("group", "i", F.coalesce("b.label", F.lit(-1)).alias("label"))


def affinity_labels(similarities: DataFrame, damping: float = AP_DAMPING, max_iter: int = AP_MAX_ITER,
                    convergence_iter: int = AP_CONVERGENCE_ITER) -> DataFrame:
    """C11 over an edge table: ``labels(group, i, label)``.

    A group has converged when its exemplars (at least one) have been the same for
    ``convergence_iter`` rounds; it then leaves the loop.  One that hasn't after ``max_iter`` rounds is -1 throughout.  A group
    whose similarities off the diagonal are all equal is all exemplars."""
    plain = cut(similarities)
    level = plain.where("i <> k").groupBy("group").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo = hi").select("group")
    alone = plain.where("i = k").select("group").distinct().join(plain.where("i <> k").select("group").distinct(), "group", "left_anti")
    even = cut(level.unionByName(alone))
    state = cut(start(tilted(plain.join(even, "group", "left_anti"))))
    before = None                                       # (group, mark, same): a fingerprint of the exemplars and its age
    done = []
    for _ in range(max_iter):
        if state.isEmpty():
            break
        state = cut(message_round(state, damping))
        groups = state.select("group").distinct()
        mark = exemplars(state).groupBy("group").agg(F.bit_xor(F.xxhash64("k")).alias("x"), F.count("*").alias("n"))
        mark = groups.join(mark, "group", "left").select("group", F.struct(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("n", F.lit(0)).alias("n")).alias("mark"))
        if before is None:
            now = mark.withColumn("same", F.lit(0))
        else:
            old = before.select("group", F.col("mark").alias("old"), F.col("same").alias("age"))
            now = mark.join(old, "group").select("group", "mark", F.when(F.col("mark") == F.col("old"), F.col("age") + 1).otherwise(F.lit(0)).alias("same"))
        before = cut(now)
        settled = cut(before.where((F.col("same") >= convergence_iter) & (F.col("mark.n") > 0)).select("group"))
        if not settled.isEmpty():
            done.append(cut(exemplars(state).join(settled, "group", "left_semi")))
            state = cut(state.join(settled, "group", "left_anti"))
    chosen = even.join(plain.where("i = k"), "group").select("group", "k")
    for part in done:
        chosen = chosen.unionByName(part)
    return assigned(plain, chosen)
