"""The registered queries and the pipeline's stages on the small tables, against brute force or DuckDB."""
import hashlib
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import test_decontaminate  # noqa: E402
import test_neardup  # noqa: E402
import test_repeats  # noqa: E402
import test_topk  # noqa: E402
from clusterscope.llm import registered  # noqa: E402
from clusterscope.llm.texts import table  # noqa: E402

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registered.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({registered.oracle_sql()[name]})").fetchall()
    got = rows_of(df)
    assert len(got) == len(want) and got == sorted(map(tuple, want), key=repr)


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


def test_op2(spark):
    want = test_neardup.brute(texts(spark, TINY))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registered.op2_bbit_minhash(spark, TINY).collect()} == want


def test_op3(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, TINY, "embeddings").collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in registered.op3_norm_sorted_topk(spark, TINY).collect())
    assert got == test_topk.brute(rows, 50)


def test_op6(spark):
    said = r"\### Assistant: </turn> ok"
    talks = {-7: [("user", said), ("assistant", said)]}
    for r in table(spark, TINY, "conversations").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in registered.op6_template_compiler(spark, TINY).collect()}
    loss = lambda turns: "".join(t for r, t in turns if r == "assistant")
    assert got == {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(loss(t)), digest(loss(t))) for c, t in talks.items()}


def test_op7(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(registered.TOKENIZER)
    at, want = 0, {}
    for i, text in texts(spark, TINY):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registered.op7_seekable_zstd(spark, TINY).collect()} == want


def test_op10(spark):
    rows = texts(spark, TINY)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registered.op10_suffix_dedup(spark, TINY).collect()}
    assert [got[i] for i, _ in rows] == test_repeats.brute([t for _, t in rows], 200)


def test_pipeline(spark, tmp_path):
    stages = corpus_pipeline.STAGES
    docs, kept = table(spark, SMALL, "documents"), []
    for k, (_, stage) in enumerate(stages):
        out = stage(spark, docs, SMALL)
        if k < len(stages) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    gone = {i for i, _ in texts(spark, SMALL)} - ids(kept[0])
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    assert sum(labels[i] == 1 for i in ids(kept[0]) if i in labels) <= 0.25 * sum(v == 1 for v in labels.values())
    assert ids(kept[1]) == {i for i, (_, _, stays) in test_neardup.brute(pairs(kept[0])).items() if stays}
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    hits = test_decontaminate.brute(pairs(kept[1]), items)
    assert ids(kept[2]) == {i for (i, _), (_, hit, _) in zip(pairs(kept[1]), hits) if not hit}
    assert sorted(pairs(kept[2])) == sorted(pairs(kept[3]))
    # the files of the last stage follow the mixture
    from clusterscope.llm.mixing import mixed, volume_targets
    order = [r.doc_id for r in mixed(kept[2], volume_targets(kept[2])).orderBy("mix_slot", "mix_place").collect()]
    assert [r.doc_id for r in kept[4].orderBy("start").collect()] == order
    sizes = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in registered.op7_seekable_zstd(spark, SMALL).collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in kept[4].collect()} == {i: sizes[i] for i in order}
