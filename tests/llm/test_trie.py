import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, every=20, heads=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % every if c >= 0 else -(-c % every))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[:len(q)] == q and len(r) > len(q) for r in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df, **options):
    return sorted((tuple(r) for r in trie.prefix_trie(df, **options).select(*COLUMNS).collect()), key=str)


def sample(seed):
    rng = random.Random(seed)
    words = ["yes", "no  way", "tell me", "", "a\x0bb c", "été d"]
    rows = []
    for c in [*range(70), -3, -20, 200, 219]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", words[rng.randrange(6) if t > 1 else t % 2]))
    rows += [(5, None, None, None), (7, 1, "user", None), (7, 1, "user", None), (None, 0, "user", "lost"), (8, 0, "us", "er:x"), (8, 0, "user", ":x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit,fan", [(2048, 2048), (4, 3), (1, 2)])
def test_matches_brute_force_over_any_number_of_bands(spark, unit, fan):
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("x")).withColumn("depth", F.lit(1)).repartition(5)
    assert got(df, unit=unit, fan=fan) == brute(rows)


def test_shared_beginning_and_crowded_end(spark):
    """A first turn that most share, and an end whose ids come in several runs."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same words here" if t < 2 or c % 3 else f"own {c % 11}") for c in range(300) for t in range(2 + c % 4)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), unit=16, fan=4, shard=20, chunk=7) == brute(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(0, t, "user", f"w{t % 3}") for t in range(1500)] + [(1, 0, "user", "x" * 300_000)]
    found = got(spark.createDataFrame(rows, SCHEMA), unit=1, fan=2)
    assert len(found) == 1501 and max(r[1] for r in found) == 1500
    assert got(spark.createDataFrame(rows[:2] + rows[-1:], SCHEMA)) == brute(rows[:2] + rows[-1:])
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_slots_are_minimal_perfect_and_verified():
    keys = np.random.default_rng(0).integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    slots = trie.Slots(keys)
    assert sorted(slots.of(keys).tolist()) == list(range(5000))
    assert (slots.of(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.concatenate([keys, keys[:1]]))
