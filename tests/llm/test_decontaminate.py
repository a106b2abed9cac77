import random
import re

from pyspark.sql import functions as F

from clusterscope.llm.decontaminate import contamination


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for _, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item, it in items:
            v = words(it)
            n = min(10, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == v[j:j + n]:
                        hit.update(range(i, i + n))
                        ids.add("" if item is None else str(item))
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


def tables(seed):
    rng = random.Random(seed)
    vocab = ["The", "É", "é", "zwölf", "10", "x", "日本"] + [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([14, 30, 10, 11, 59, 9, 3, 1])]
    items = items[:-1] + [(7, ["solo"]), (12, None), (None, say(12)), (3, say(15))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "solo")]
    for i in range(4, 60):
        body = say(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            _, w = rng.choice([x for x in items if x[1]])
            a = rng.randrange(len(w))
            at = rng.randrange(len(body) + 1)
            body[at:at] = w[a:a + rng.randrange(1, 20)]
        if rng.random() < 0.1:
            body = ["x"] * 40
        docs.append((i, rng.choice([" ", ", ", "--"]).join(w.upper() if rng.random() < .2 and w.isascii() else w for w in body)))
    return docs, [(i, None if w is None else " ".join(w)) for i, w in items] + [(20, " ".join(["x"] * 12))]


def test_matches_brute_force(spark):
    docs, items = tables(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = contamination(d, b).collect()
    got = {r.doc_id: (r.n_words, sorted(r.hits), r.item_ids) for r in rows}
    assert [got[i] for i, _ in docs] == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_hit == len(r.hits) for r in rows)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, text), (1, text), (1, "other"), (None, text)], "doc_id long, text string")
    b = spark.createDataFrame([(4, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in contamination(d, b).collect())
    assert got == [(0, 20, 12), (1, 1, 0), (1, 20, 12), (1, 20, 12)]
    assert contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(d.limit(0), b).count() == 0
