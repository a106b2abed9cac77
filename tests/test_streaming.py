"""Incremental preparation by Structured Streaming equals the batch preparation."""

import os
import shutil
import tempfile

from clusterscope.operators.index import build_impacts
from clusterscope.operators.pages import page_fields
from clusterscope.sources.tables import read_pages
from clusterscope.streaming.incremental import prepared_tables, start_incremental_prepare

SF = "/root/testdata/sf0.001"


def test_incremental_prepare_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="cs-stream-")
    src = os.path.join(root, "in")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    # two crawl deliveries; the second repeats a URL of the first (first wins)
    pages.where("page_id < 25").write.parquet(f"{src}/b1")
    pages.where("page_id >= 20").write.parquet(f"{src}/b2")
    q = start_incremental_prepare(spark, f"{src}/*", f"{root}/out", f"{root}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(300)
    got = prepared_tables(spark, f"{root}/out")
    batch = page_fields(read_pages(spark, SF))
    cols = ["domain", "page_id", "url", "title", "plaintext", "fulltext"]
    a = sorted(tuple(r) for r in got["fields"].select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b
    ia = sorted((r.domain, r.term, r.page_id, round(r.s_plaintext, 9)) for r in got["impacts"].collect())
    ib = sorted((r.domain, r.term, r.page_id, round(r.s_plaintext, 9)) for r in build_impacts(batch).collect())
    assert ia == ib
    assert got["vectors"].select("page_id").distinct().count() == batch.count()


def test_a_batch_killed_at_any_write_is_replayed_whole(spark, monkeypatch):
    """Failure before every write of the second batch, then the same batch again: the tables of one undisturbed run."""
    from clusterscope.streaming import incremental

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    first, second = pages.where("page_id < 20"), pages.where("page_id >= 15")
    begun = tempfile.mkdtemp(prefix="cs-replay-")
    incremental.prepare_batch(first, f"{begun}/out", 0)
    whole = shutil.copytree(f"{begun}/out", f"{begun}/whole")
    incremental.prepare_batch(second, whole, 1)

    def counts(root):
        return {n: (t.count(), t.select("page_id").distinct().count()) for n, t in prepared_tables(spark, root).items()}
    want = counts(whole)
    assert want["fields"][0] == page_fields(read_pages(spark, SF)).count()
    write, commit = incremental._write, incremental._commit
    for dies_at in (*incremental.TABLES, "commit"):
        root = shutil.copytree(f"{begun}/out", f"{begun}/{dies_at}")

        def stop(*args):
            raise RuntimeError("killed")
        monkeypatch.setattr(incremental, "_write", lambda t, r, n, b: stop() if n == dies_at else write(t, r, n, b))
        monkeypatch.setattr(incremental, "_commit", stop if dies_at == "commit" else commit)
        try:
            incremental.prepare_batch(second, root, 1)
            raise AssertionError("not killed")
        except RuntimeError:
            pass
        assert prepared_tables(spark, root)["fields"].count() == 20          # as before the batch
        monkeypatch.setattr(incremental, "_write", write)
        monkeypatch.setattr(incremental, "_commit", commit)
        incremental.prepare_batch(second, root, 1)
        assert counts(root) == want
