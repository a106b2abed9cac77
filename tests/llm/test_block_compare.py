"""Sets compared block against block, and buckets compared in chunks."""

import numpy as np
import pyarrow as pa
import pytest

from clusterscope.llm import decontaminate, neardup


def test_shared_tokens_counts_every_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.int64) - 150) for n in (0, 1, 90, 120, 200, 7)] * 10
    got = neardup.shared_tokens(sets[:40], sets)
    assert got.shape == (60, 40)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets[:40]))
    assert neardup.shared_tokens([np.zeros(0, np.int64)], [sets[2]]).tolist() == [[0]]


@pytest.mark.parametrize("few", [1, 2048])
def test_groups_that_do_not_link_are_compared_in_chunks(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(30):
        words = list(base)
        for at in rng.choice(120, 1 + d % 4, replace=False):
            words[at] = f"x{d}_{at}"
        rows.append((d, " ".join(words)))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(116)} for _, t in rows]
    label = list(range(30))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(set(label)) > 1
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_candidates_are_grouped_by_block():
    entries = pa.array([[{"block": 9, "other": 4}, {"block": 7, "other": 5}, {"block": 9, "other": 4}, {"block": 9, "other": 3}]],
                       pa.list_(pa.struct([("block", pa.int64()), ("other", pa.int64())])))
    out = list(neardup._by_block(iter([pa.RecordBatch.from_arrays([pa.array([1]), entries], names=["node", "alike"])])))
    assert [r for b in out for r in b.to_pylist()] == [{"node": 1, "block": 7, "others": [5]}, {"node": 1, "block": 9, "others": [3, 4]}]


def test_words_of_one_byte_texts_are_the_same_by_either_pattern(spark):
    import re
    texts = ["".join(map(chr, range(128))), "", "Ab-c9_Z", "\x00a\x7fb", "É Ab", "aÉK", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    low = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    got = {r.i: r.w for r in df.select("i", decontaminate.words(df.t).alias("w")).collect()}
    assert got == {i: re.findall(decontaminate.WORD, (t or "").translate(low)) for i, t in enumerate(texts)}
    assert re.fullmatch(decontaminate.ONE_BYTE_WORD, "a9")


def test_a_node_has_one_row_for_two_tiles_however_many_blocks():
    from clusterscope.llm import sigtree

    sets = [np.unique(np.append(np.arange(100, dtype=np.uint64) << np.uint64(24), np.uint64(1 << 40) + np.uint64(i))) for i in range(12)]
    row = {"nodes": list(range(12)), "blocks": list(range(100, 112)), "sizes": [len(s) for s in sets], "components": list(range(12)),
           "bits": [sigtree.bitmap(s).tobytes() for s in sets]}
    out = list(sigtree._within(85)(iter([pa.RecordBatch.from_pylist([row])])))
    rows = [r for b in out for r in b.to_pylist()]
    assert sorted(r["node"] for r in rows) == list(range(11))
    assert {(r["node"], e["other"]) for r in rows for e in r["alike"]} == {(i, j) for i in range(12) for j in range(i + 1, 12)}
