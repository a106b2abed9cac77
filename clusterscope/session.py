"""Spark session helpers.

The library itself never creates a session: every operator takes DataFrames.
These helpers are for tests, bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "clusterscope") -> SparkSession:
    """Local session with AQE on and the UI off (tests / bench only)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...)
    and we use it as is.  Only a local master may go without: it gets a
    scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="clusterscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``clusterscope`` importable in Python workers (for pandas UDFs):
    zip the package once per application and ``addPyFile`` it, which the
    driver's file server distributes to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    # already shipped with the job (spark-submit --py-files ...clusterscope...)
    if "clusterscope" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(app)
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="clusterscope-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING = threading.Lock()
_writers: dict[str, list] = {}


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that are started here go when their job has ended; else they stay until the
    driver happens to collect its garbage."""
    app = spark.sparkContext.applicationId
    with _WRITING:
        held = _writers.setdefault(app, [0, None])
        if not held[0]:
            held[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _WRITING:
            held[0] -= 1
            if not held[0]:
                spark.conf.unset(_CLEANUP) if held[1] is None else spark.conf.set(_CLEANUP, held[1])


def cut(df):
    """Materialise a reused intermediate and cut its lineage: written once as
    Parquet into the shared ``spark.checkpoint.dir`` (never a local folder)
    and read back.  Unlike ``checkpoint()`` on an unpersisted plan, this
    computes the plan a single time, and later reads prune columns."""
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusterscope-cut/{uuid.uuid4().hex}"
    with released(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(df) -> None:
    """Delete a table that ``cut`` wrote and that no plan reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/clusterscope-cut/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df) -> int:
    """The planner's estimate of a table's size, from the sizes of the files that it reads; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


FEW_BYTES = 4 << 20


def of_keys(table, keys, *on):
    """The rows of ``table`` whose ``on`` columns ``keys`` has, kept before a join deals the whole table out, if ``keys`` is a small
    written table (by the planner's estimate); else ``table`` as it is, which the join reduces all the same."""
    from pyspark.sql import functions as F

    keys = keys.select(*on)
    return table.join(F.broadcast(keys.distinct()), list(on), "left_semi") if estimated_bytes(keys) <= FEW_BYTES else table


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


PIECE_BYTES = 4 << 20


def pieces(df, size: int = PIECE_BYTES) -> int:
    """Partitions for ``df`` of about ``size`` bytes of its input files each, at least one per core:
    a task's share stays the same however large the input is."""
    spark = df.sparkSession
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(parallelism(spark), -(-total // size))


def by_page(fields):
    """``fields`` dealt by page: aggregates on ``(domain, page_id)`` and further keys then need no
    exchange of their own, so the texts travel and not a row per token."""
    return fields.repartition(pieces(fields), "domain", "page_id")


def spread(df, *keys):
    """Give a small *scanned* input enough partitions for the cluster's cores
    before heavy narrow work (HTML extraction).  Inputs that already have that
    many partitions (the large-data case) are left as they are, so this never
    adds a shuffle at scale.  Only for scan/project/filter plans: asking an
    adaptive plan with shuffles for its partitions would run those stages."""
    n = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *keys) if keys else df.repartition(n)
