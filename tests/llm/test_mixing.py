from pyspark.sql import functions as F

from clusterscope.llm.mixing import cycle_table, in_mixture_order, mixed


def edf(shares, q):
    """Slots of one cycle by simulation."""
    had, out = [0] * len(shares), []
    for t in range(q):
        due = [(-(-(h + 1) * q // a), i) for i, (h, a) in enumerate(zip(had, shares)) if h < a and h * q // a <= t]
        i = min(due)[1]
        out.append((i, had[i]))
        had[i] += 1
    return out


def test_cycle_keeps_every_source_within_a_block(spark):
    weights = [("a", 50), ("b", 30), ("c", 7), ("d", 1), ("e", 0), ("f", None), ("g", 333)]
    rows = cycle_table(spark.createDataFrame(weights, "key string, weight long"), 100).orderBy("slot").collect()
    keys = [k for k, _ in weights]
    shares = {r.key: r.slots for r in rows}
    assert sum(shares.values()) == 100 == len(rows) and min(shares.values()) == 1
    assert [(keys.index(r.key), r.nth) for r in rows] == edf([shares[k] for k in keys], 100)
    for t in range(101):
        for k in keys:
            assert abs(sum(r.key == k for r in rows[:t]) - t * shares[k] / 100) < 1


def test_mixture_follows_targets_and_keeps_all_rows(spark):
    docs = ([(i, "a", "x" * 10) for i in range(900)] + [(1000 + i, "b", "y" * 30) for i in range(100)] + [(2000 + i, None, "z") for i in range(200)]
            + [(3000, "c", None), (3001, "c", ""), (None, "c", "null id"), (3002, "big", "w" * 5000), (5, "a", "x" * 10)])
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("mix_slot", F.lit("clash")).withColumn("key", F.lit(1))
    targets = spark.createDataFrame([("a", 60), ("b", 30), ("unknown", 9)], "source string, weight long")
    rows = mixed(df, targets, size=F.lit(1), block_size=10, cycle=50, chunks=16).collect()
    assert sorted((r.doc_id or -1, r.source or "", r.text or "") for r in rows) == sorted((d or -1, s or "", t or "") for d, s, t in docs)
    for s in {r.source for r in rows}:
        own = sorted(r.mix_place for r in rows if r.source == s)
        assert own == list(range(len(own)))
        assert all(r.mix_block == r.mix_place // 10 for r in rows if r.source == s)
    slots = {}
    for r in rows:
        slots.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert all(len(v) == 1 for v in slots.values())
    shares = {"a": 50 - 4 - 15, "b": 15 + 1}
    had = {r.source: r for r in rows}
    blocks = {s: -(-sum(r.source == s for r in rows) // 10) for s in had}
    table = {s: sorted(t for t, v in slots.items() if next(iter(v))[0] == s) for s in had}
    n = {s: sum(t < 50 for t in table[s]) for s in had}
    assert n["a"] + n["b"] + n[None] + n["c"] + n["big"] <= 50 and abs(n["a"] - shares["a"]) <= 1
    a = n["a"]
    for t in range(0, max(slots) + 1):
        assert abs(sum(x < t for x in table["a"]) - min(blocks["a"], t * a / 50)) < 1


def test_order_volume_blocks_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "s%d" % (i % 3), "t" * (i % 50)) for i in range(400)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("s0", 3), ("s1", 2), ("s2", 1)], "source string, weight long")
    placed = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixed(docs, targets, block_size=100).collect()}
    laid = in_mixture_order(docs, targets, block_size=100)
    assert laid.columns == docs.columns
    ids = [r.doc_id for r in laid.collect()]
    assert ids == sorted(placed, key=placed.get)
    volume = {}
    for r in sorted(mixed(docs, targets, block_size=100).collect(), key=lambda r: r.mix_place):
        assert r.mix_block == volume.get(r.source, 0) // 100
        volume[r.source] = volume.get(r.source, 0) + len(r.text)
    assert mixed(docs.limit(0), targets).count() == 0
    assert mixed(docs, targets.limit(0)).count() == 400
