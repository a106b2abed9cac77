"""Incremental site preparation as a Structured Streaming job.

Crawls deliver page files over time (the crawler appends to its manifest).
``start_incremental_prepare`` reads new page Parquet files as a stream and,
per micro-batch (``foreachBatch``):

* extracts the page fields of the new pages, skipping URLs that an earlier
  batch has prepared (first occurrence wins across batches, as in the manifest reader);
* writes them, with their similarity vectors, norms and passages, as the
  batch's own folder ``<table>/batch=<id>`` of every prepared table;
* rebuilds the BM25 impacts of the touched domains (document frequencies and
  lengths are per domain) into the batch's folder of the impacts;
* leaves a commit record, written last.

Readers and later batches see batches with a commit record only.  A batch that dies between any two
writes is replayed under its own id, overwrites what it had written and reads nothing of it, so every
page comes out exactly once.  The stream's progress lives in its checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import registered_domain
from ..operators.index import build_impacts
from ..operators.pages import dedupe_urls, page_fields
from ..operators.search import page_passages
from ..operators.similarity import page_norms, page_vectors
from ..session import cut

PAGE_SCHEMA = "page_id long, url string, html string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


TABLES = ("fields", "vectors", "norms", "passages", "impacts")


def committed_batches(spark: SparkSession, out_root: str) -> list[int]:
    """Ids of the batches whose commit record is there (one short file name per batch)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{out_root}/commits")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(root)) if fs.exists(root) else []


def _commit(spark: SparkSession, out_root: str, batch_id: int) -> None:
    record = spark._jvm.org.apache.hadoop.fs.Path(f"{out_root}/commits/{batch_id}")
    record.getFileSystem(spark._jsc.hadoopConfiguration()).create(record, True).close()


def _write(table: DataFrame, out_root: str, name: str, batch_id: int) -> None:
    table.write.mode("overwrite").partitionBy("domain").parquet(f"{out_root}/{name}/batch={batch_id}")


def _read(spark: SparkSession, out_root: str, name: str, batches: list[int]) -> DataFrame:
    """A table's rows of the given batches, with the column ``batch``."""
    paths = [p for p in (f"{out_root}/{name}/batch={b}" for b in batches) if _exists(spark, p)]
    return spark.read.option("basePath", f"{out_root}/{name}").parquet(*paths)


def prepare_batch(batch: DataFrame, out_root: str, batch_id: int) -> None:
    """One micro-batch: the new pages' rows of every table, the impacts of the touched domains, the commit record."""
    spark = batch.sparkSession
    earlier = [b for b in committed_batches(spark, out_root) if b != batch_id]
    pages = batch.select(registered_domain("url").alias("domain"), "page_id", "url", "html")
    fields = dedupe_urls(page_fields(pages, dedupe=False))
    if earlier:
        fields = fields.join(_read(spark, out_root, "fields", earlier).select("domain", "url"), ["domain", "url"], "left_anti")
    fields = cut(fields)
    if fields.isEmpty():
        return
    _write(fields, out_root, "fields", batch_id)
    _write(page_vectors(fields), out_root, "vectors", batch_id)
    _write(page_norms(fields), out_root, "norms", batch_id)
    _write(page_passages(fields), out_root, "passages", batch_id)
    touched = fields
    if earlier:
        old = _read(spark, out_root, "fields", earlier).join(fields.select("domain").distinct(), "domain", "left_semi")
        touched = fields.unionByName(old.select(*fields.columns))
    _write(build_impacts(touched), out_root, "impacts", batch_id)
    _commit(spark, out_root, batch_id)


def start_incremental_prepare(spark: SparkSession, pages_dir: str, out_root: str, checkpoint: str,
                              available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(pages_dir)
    writer = (stream.writeStream.foreachBatch(lambda df, batch_id: prepare_batch(df, out_root, batch_id))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def prepared_tables(spark: SparkSession, out_root: str) -> dict[str, DataFrame]:
    """The prepared tables as of the committed batches; a domain's impacts are those of the last batch that touched it."""
    batches = committed_batches(spark, out_root)
    out = {n: _read(spark, out_root, n, batches) for n in TABLES}
    last = out["fields"].groupBy("domain").agg(F.max("batch").alias("batch"))
    out["impacts"] = out["impacts"].join(last, ["domain", "batch"], "left_semi")
    return {n: t.drop("batch") for n, t in out.items()}
