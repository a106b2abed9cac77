"""What jobs leave on disk: no shuffle files of written tables, no table that nothing reads any more."""

from pathlib import Path

from pyspark.sql import functions as F

from clusterscope.plans.prepare import materialize
from clusterscope.session import cut, ensure_checkpoint_dir


def cuts(spark):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "clusterscope-cut"
    return set(folder.iterdir()) if folder.exists() else set()


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f and f.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    t = cut(spark.range(10_000).repartition(4, "id").withColumn("k", F.col("id") % 7).groupBy("k").count())
    assert sorted(r["count"] for r in t.collect()) == [1428] * 3 + [1429] * 4
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_preparation_leaves_only_its_tables(spark, tmp_path):
    rows = [(i, f"https://www.a.org/p{i}", f"<html><head><title>t {i}</title></head><body><p>word{i % 3} all</p></body></html>") for i in range(9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    before, shuffled = cuts(spark), shuffle_files(spark)
    prep = materialize(spark, str(tmp_path))
    assert cuts(spark) == before and not shuffle_files(spark) - shuffled
    assert prep.fields.count() == 9 and prep.norms.count() == 9
    # "t" and "all" are on every page, a word on three pages each, and the numbers of the titles on one
    assert {r.term for r in prep.vectors.where("field = 'plaintext'").collect()} >= {"all", "word0", "word1", "word2"}
    assert prep.impacts.where("term = 'all'").count() == 9
