import io
import random
import sys
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from clusterscope.llm import token_files
from clusterscope.llm.registered import TOKENIZER

TEXTS = [None, "", " ", "a", " a", "a ", "  a  b ", "x\ny", "x \n y", "don't 's it's", "tab\tb \t c", "été ñ 日本語 日本",
         "a b c  d", "x" * 300, "10 20 30,5 %%%", "<|endoftext|> in text", "a\r\n b c   d", "\u0085 x \u0085"]


def corpus():
    rng = random.Random(5)
    glyphs = ["ab", "é", " ", "  ", "\n", ".", "'s", "7", "日", "\t", "Z", "-", " the", " x1", " ", "\U0001f600"]
    return TEXTS + ["".join(rng.choice(glyphs) for _ in range(rng.randrange(200))) for _ in range(300)]


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts(direct, monkeypatch):
    e = token_files.Encoder(TOKENIZER, "u2")
    texts = corpus() * 2
    for text, ids in zip(texts, e.encode([t or "" for t in texts])):
        assert np.frombuffer(ids, "<u2").tolist() == direct(text)
    monkeypatch.setattr(token_files, "CACHE_WORDS", 10)
    e = token_files.Encoder(TOKENIZER, "u2")
    for text in corpus():
        assert np.frombuffer(e.encode([text or ""])[0], "<u2").tolist() == direct(text)


def test_round_trip_of_a_file():
    rng = np.random.default_rng(3)
    docs = [(None if i == 0 else i * 7, rng.integers(0, 50257, rng.integers(0, 900)).astype("<u2")) for i in range(50)]
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    w = token_files.Writer(out, "u2", frame_bytes=4000)
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    r = token_files.Reader(out)
    assert len(r.table) > 5
    for i in rng.permutation(50):
        assert r.document(i).tolist() == docs[i][1].tolist()
    assert [x.tolist() for _, x in r.documents()] == [x.tolist() for _, x in docs]
    # a plain zstandard reader sees the frames one after the other
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(ids.tobytes() for _, ids in docs)
    broken = bytearray(out.getvalue())
    broken[int(r.starts[2]) + 40] ^= 255
    bad = token_files.Reader(io.BytesIO(bytes(broken)))
    assert bad.document(0).tolist() == docs[0][1].tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.frame(2)
    close()


def test_documents_come_back_in_order(spark, direct):
    texts = corpus()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    got = token_files.token_output(df, TOKENIZER).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    at = 0
    for r, (_, text) in zip(got, order):
        ids = np.array(direct(text) + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_output(df.limit(0), TOKENIZER).count() == 0
    assert sys.byteorder == "little"
