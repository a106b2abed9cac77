import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.llm import sigtree


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in sigtree.similarity_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def families(seed, n, edits, length=40):
    rng = random.Random(seed)
    quoted = [f"quote{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([1, 3, 4, length, 2 * length]))]
        if rng.random() < .5:
            words[len(words) // 2:len(words) // 2] = quoted
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(2000)}"
            rows.append((len(rows), rng.choice([" ", "\t", "\n "]).join(copy)))
    rng.shuffle(rows)
    return rows


EDGES = [(None, "a b c d e"), (None, "a b c d e"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two three four"), (9005, "ONE two\x0bthree  four"),
         (9006, "Ä b"), (9007, "ä b"), (9010, "x1 x2 x3 x4 x5"), (9012, "x1 x2 x3 x4 x5"), (9012, "y1 y2 y3 y4 y5"), (9011, "y1 y2 y3 y4 y5"),
         (9013, "y1 y2 y3 y4 y5"), (9013, "y1 y2 y3 y4 y5"), (9020, " ".join(f"z{i % 977}" for i in range(60_000)))]


@pytest.mark.parametrize("rounds,tile,fan", [(2, 256, 32), (0, 2, 2)])
def test_matches_all_pairs(spark, monkeypatch, rounds, tile, fan):
    """With leaders, and by the traversal of small tiles over several levels alone."""
    for name, value in (("LEAD_ROUNDS", rounds), ("LEAD_FROM", 1), ("TILE", tile), ("FAN", fan)):
        monkeypatch.setattr(sigtree, name, value)
    rows = families(1, 60, 3) + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("node", F.lit(1)).repartition(5)
    assert got(df) == brute(rows)


def test_one_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch):
    """Copies that chain into one component, and many texts around one passage."""
    monkeypatch.setattr(sigtree, "HOT_ROWS", 8)
    monkeypatch.setattr(sigtree, "LEAD_FROM", 8)
    monkeypatch.setattr(sigtree, "TILE", 16)
    monkeypatch.setattr(sigtree, "FAN", 2)
    rng = random.Random(3)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    for i in range(150, 260):
        rows.append((i, " ".join([f"o{rng.randrange(10 ** 6)}" for _ in range(30)] + base[:25] + [f"p{rng.randrange(10 ** 6)}" for _ in range(30)])))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_other_thresholds_and_empty_table(spark):
    rows = families(5, 30, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, percent=60) == brute(rows, 60)
    assert got(df, percent=100) == brute(rows, 100)
    assert got(df.limit(0)) == []


def test_bounds_hold():
    """The possible overlap is never below the true one, for bitmaps of any two lengths and for nodes."""
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    for n, m in ((300, 280), (5000, 4500), (700, 5000)):
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        bound = sigtree.possible_overlap(sigtree.bitmap(x)[None], np.array([len(x)]), sigtree.bitmap(y)[None], np.array([len(y)]))[0, 0]
        assert bound >= len(np.intersect1d(x, y))
    assert [sigtree.prefix_size(n, 85) for n in (0, 1, 6, 7, 100)] == [0, 1, 1, 2, 16]
    assert [sigtree.prefix_size(n, 100) for n in (1, 50)] == [1, 1]
