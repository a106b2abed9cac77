"""Site preparation (A6): page fields -> search index -> similarity vectors.

``prepare`` is lazy (a plan).  ``materialize`` writes the prepared tables as
Parquet under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), which also cuts lineage: query jobs read the
written tables, and a lost executor only re-runs a stage of the job that
lost it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import build_impacts, impacts_of, term_frequencies
from ..operators.pages import page_fields
from ..operators.search import page_passages
from ..operators.similarity import page_norms, page_vectors, shared_vectors
from ..session import cut, discard, ensure_checkpoint_dir, parallelism, released, spread
from ..sources.tables import read_pages


@dataclass
class Prepared:
    fields: DataFrame    # (domain, page_id, url, url_hash, url_text, title, plaintext, fulltext)
    impacts: DataFrame   # (domain, term, page_id, s_title, s_plaintext, s_fulltext)
    vectors: DataFrame   # (domain, page_id, field, term, tf) — terms shared by >= 2 pages of a site
    norms: DataFrame     # (domain, page_id, n_url, n_title, n_fulltext, n_plaintext, title_ok)
    passages: DataFrame  # (domain, page_id, src, i, s, toks) — highlight sentences


def prepare(pages: DataFrame) -> Prepared:
    fields = page_fields(pages)
    return Prepared(fields=fields, impacts=build_impacts(fields), vectors=shared_vectors(page_vectors(fields)),
                    norms=page_norms(fields), passages=page_passages(fields))


_TABLES = ("fields", "impacts", "vectors", "norms", "passages")


def _key(spark: SparkSession, sf_dir: str) -> str:
    """A name for the input as it is now: path, size and time of all files of the pages, by the
    file system that holds them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/pages.parquet")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(root) if fs.exists(root) else []
    stamps = sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in files)
    return hashlib.sha1("\n".join([fs.makeQualified(root).toString(), *stamps]).encode()).hexdigest()[:16]


def prepared_root(spark: SparkSession, sf_dir: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusterscope-prepared/{_key(spark, sf_dir)}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def materialize(spark: SparkSession, sf_dir: str, force: bool = False) -> Prepared:
    """Write the prepared tables once per input (keyed by path and mtime) and
    return DataFrames reading them."""
    root = prepared_root(spark, sf_dir)
    todo = [n for n in _TABLES if force or not _exists(spark, f"{root}/{n}")]
    if todo:
        # the page fields feed every other table: they are written first, dealt by page, and the rest is
        # derived from the written copy, one table after the other, so that only one table's shuffle files lie there
        def write(name: str, table: DataFrame) -> None:
            with released(spark):
                table.write.mode("overwrite").parquet(f"{root}/{name}")

        pages = spread(read_pages(spark, sf_dir), "page_id")
        write("fields", page_fields(pages).repartition(parallelism(spark), "domain", "page_id"))
        fields = spark.read.parquet(f"{root}/fields")
        write("norms", page_norms(fields))
        write("passages", page_passages(fields))
        write("vectors", shared_vectors(page_vectors(fields)))
        tf = cut(term_frequencies(fields))
        write("impacts", impacts_of(tf))
        discard(tf)
    return Prepared(*[spark.read.parquet(f"{root}/{n}") for n in _TABLES])
