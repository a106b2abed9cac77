import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from clusterscope.llm import repeats


def brute(texts, m):
    """n_removed, n_spans and kept bytes per text, from counts of all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - m + 1):
            seen[r[i:i + m]] = seen.get(r[i:i + m], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - m + 1):
            if seen[r[i:i + m]] > 1:
                gone[i:i + m] = b"\1" * m
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, length=900):
    rng = random.Random(seed)
    words = ["alpha", "bé", "gamma", "de", "éps", "zeta", "e", "theta", "日本", "k"]
    say = lambda k: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(k))
    passages = [say(60) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0 and texts:
            texts.append(rng.choice([t for t in texts if t is not None] or [""]))
        elif kind == 1 and texts:
            base = (rng.choice([t for t in texts if t is not None] or [""])).split(" ")
            if base:
                base[rng.randrange(len(base))] = "edit" + str(rng.randrange(9))
            texts.append(" ".join(base))
        elif kind == 2:
            texts.append(say(rng.randrange(20)) + " " + rng.choice(passages) + " " + say(rng.randrange(20)))
        elif kind == 3:
            texts.append(("ab " * rng.randrange(1, 200)).strip() + say(5))
        else:
            texts.append(say(rng.randrange(1, length // 8)))
    return texts + [None, "", "x", "x" * 199, "y" * 200, "z" * 201]


@pytest.mark.parametrize("many", [2000, 2])
def test_matches_window_counts(spark, many):
    texts = corpus(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in repeats.remove_repeats(df, many_texts=many).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, repeats.MIN_LEN)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    texts = corpus(11, n=12, length=6000)
    from pyspark.sql import SparkSession  # noqa: F401
    import numpy as np
    segments = []
    monkeypatch.setattr(repeats, "PIECE_BYTES", 1000)
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    for _, a, b in repeats._long_rows(data, None, 200):
        row, lo, windows, *_ = repeats._segments(data[a:b], np.array([0, b - a]), 200)
        segments += [(a + x, n) for x, n in zip(lo.tolist(), windows.tolist())]
    starts = sorted(x + i for x, n in segments for i in range(n))
    assert starts == list(range(len(data) - 199))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = corpus(3, n=1, length=3000)[0] + " tail" * 60
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (1, "other")], "doc_id long, text string")
    rows = repeats.remove_repeats(df).collect()
    whole = len(text.encode())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in rows) == sorted(
        [(1, whole, whole), (1, whole, whole), (-1, whole, whole), (2, 0, 0), (1, 5, 0)])
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_groups_hold_all_occurrences():
    a, b = b"q" + bytes(range(97, 123)) * 9, b"r" + bytes(range(97, 123)) * 9
    found = repeats.maximal_repeats([a[:230], b[:230]], 200)
    tops = {(g, n) for g, _, _, n in found}
    assert (2, 229) in {(len([1 for g2, *_ in found if g2 == g]), n) for g, n in tops}


def test_suffixes_that_part_after_the_last_rank_in_all_orders():
    rng = random.Random(5)
    base = bytes(rng.randrange(97, 123) for _ in range(368))
    texts = [base[:300] + b"#" + base[301:], base[:235] + b"#" + base[236:], base]
    for order in itertools.permutations(texts):
        gone = [set() for _ in order]
        for _, t, start, length in repeats.maximal_repeats(list(order), 200):
            gone[t].update(range(start, start + length))
        want = {texts[0]: 300, texts[1]: 235, texts[2]: 300}
        assert [(len(g), max(g)) for g in gone] == [(want[t], want[t] - 1) for t in order]


def test_crowded_anchor_with_many_groups_of_copies(spark):
    """Many texts around one passage, most with a copy of their own, by the tables of windows met and by exact counts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(45))
    texts = []
    for i in range(120):
        text = " ".join(word() for _ in range(25)) + passage[rng.randrange(20):len(passage) - rng.randrange(20)] + " ".join(word() for _ in range(25))
        texts += [text] * (2 if i % 3 else 1)
    rng.shuffle(texts)
    want = brute(texts, repeats.MIN_LEN)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for many in (2000, 10, 0):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, many_texts=many).collect()}
        assert [got[i] for i in range(len(texts))] == want
