import random
import re

import pytest
from pyspark.sql import functions as F

from clusterscope.llm import neardup


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    p, q = find(a), find(b)
                    comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["Wort", "déjà", "the", "OF", "x", "日", "Ünder", "a b"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a  B\nc\td", "a b c d e"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_chain_in_one_bucket_needs_later_leaders(spark):
    # neighbours overlap enough, the first and the last do not
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 8:i * 8 + 180])) for i in range(8)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows).items()}
    assert set(got.values()) == {0}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 46, 0, True), (5, 46, 5, True), (5, 46, 5, True), (7, 0, 7, True), (9, 46, 5, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_one_doc_id_with_two_texts_is_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (11, c), (12, c + " more"), (20, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 3, False), (12, 3, False), (20, 20, True)}
    assert sorted(tuple(r) for r in neardup.without_near_duplicates(df).collect()) == [(3, a), (20, "x y z")]


def test_estimate_follows_similarity(spark):
    import numpy as np
    import pyarrow as pa
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    texts = [" ".join(base)] + [" ".join(base[:800 - k] + [f"v{k}x{i}" for i in range(k)]) for k in (0, 60, 200, 400, 800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})
    sig = next(neardup._signatures([batch]))
    low = np.stack([sig.column(f"low{w}").to_numpy().view(np.uint64) for w in range(neardup._WORDS)], 1)
    for i in range(1, 6):
        a, b = shingles(texts[0]), shingles(texts[i])
        x = low[0] ^ low[i]
        differ = sum(int(v).bit_count() for v in (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        estimate = (1 - differ / (neardup.BANDS * neardup.ROWS) - 0.25) / 0.75
        assert abs(estimate - len(a & b) / len(a | b)) < 0.13


@pytest.mark.parametrize("percent, shared", [(80, 173), (60, 145), (50, 128)])
def test_bands_follow_the_threshold(spark, percent, shared):
    assert neardup.banding(85) == (48, 8)
    bands, rows = neardup.banding(percent)
    assert bands * rows <= neardup.BANDS * neardup.ROWS and (1 - (percent / 100) ** rows) ** bands < 3e-7
    # 300 pairs of 192 shingles, of which ``shared`` agree: just above the threshold
    docs = []
    for p in range(300):
        words = [f"p{p}w{i}" for i in range(196)]
        docs += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(words[:shared + 4] + [f"p{p}v{i}" for i in range(192 - shared)]))]
    a, b = shingles(docs[0][1]), shingles(docs[1][1])
    assert percent <= 100 * len(a & b) / len(a | b) < percent + 2
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i, _ in docs}
