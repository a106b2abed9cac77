"""The page-similarity store (M4; S6 upsert, S7 scan).

Rows ``(url1_hash, url2_hash, url1, url2, url/title/fulltext/plaintext
_sim_score)`` keyed by the two MD5 hashes in canonical order
(``url1_hash < url2_hash``), so a pair is stored once whichever way it was
computed.

On disk (``StoredSimilarities``) the rows lie in partitions by the first ``PREFIX`` hex digits of
``url1_hash``.  An upsert reads and overwrites the partitions of its own keys only (dynamic partition
overwrite), so it costs what it touches; a scan prunes the partitions that none of its pairs fall in.  Sorted by
url1, an update of some pages' pairs touches few partitions; pairs of random pages touch all, and then all are
rewritten, as without partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SIM_FIELDS
from ..session import cut

KEY = ["url1_hash", "url2_hash"]
SCORES = [f"{f}_sim_score" for f in SIM_FIELDS]


def canonical_rows(pair_sims: DataFrame) -> DataFrame:
    """From ``(url_a, url_b, <scores>)`` rows to canonical store rows; one row per key."""
    ha, hb = F.md5("url_a"), F.md5("url_b")
    swap = ha > hb
    rows = pair_sims.select(
        F.when(swap, hb).otherwise(ha).alias("url1_hash"),
        F.when(swap, ha).otherwise(hb).alias("url2_hash"),
        F.when(swap, F.col("url_b")).otherwise(F.col("url_a")).alias("url1"),
        F.when(swap, F.col("url_a")).otherwise(F.col("url_b")).alias("url2"),
        *SCORES)
    # the same page pair met in several queries carries identical scores
    return rows.groupBy(*KEY).agg(F.max("url1").alias("url1"), F.max("url2").alias("url2"),
                                  *[F.max(c).alias(c) for c in SCORES])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace-into on the key: new rows win, untouched old rows stay."""
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new.select(*old.columns))


def scan(store: DataFrame, hits: DataFrame) -> DataFrame:
    """The stored rows among each query's hits, as hit-pair rows
    ``(query_id, rank_a, rank_b, url_a, url_b, <scores>)`` with rank_a < rank_b."""
    h = hits.select("query_id", "rank", "url", F.md5("url").alias("h"))
    a = h.select("query_id", F.col("rank").alias("rank_a"), F.col("url").alias("url_a"), F.col("h").alias("ha"))
    b = h.select("query_id", F.col("rank").alias("rank_b"), F.col("url").alias("url_b"), F.col("h").alias("hb"))
    pairs = a.join(b, "query_id").where(F.col("rank_a") < F.col("rank_b"))
    pairs = pairs.select("*", F.least("ha", "hb").alias("url1_hash"), F.greatest("ha", "hb").alias("url2_hash"))
    return pairs.join(store, KEY).select("query_id", "rank_a", "rank_b", "url_a", "url_b", *SCORES)


PREFIX = 2                                              # 256 partitions at most
_PART = "part"


def _parts(keys: DataFrame) -> list[str]:
    """The partitions of some keys: at most 16 ** PREFIX short strings."""
    return [r[0] for r in keys.select(F.substring("url1_hash", 1, PREFIX)).distinct().collect()]


class StoredSimilarities:
    """The store at ``path``; rows come and go as canonical rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rows(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some partitions (the others aren't listed as input)."""
        columns = [*KEY, "url1", "url2", *SCORES]
        if not self._there():
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns[:4]) + ", " + ", ".join(f"{c} double" for c in SCORES))
        self.spark.catalog.refreshByPath(self.path)
        schema = ", ".join(f"{c} {'double' if c in SCORES else 'string'}" for c in columns) + f", {_PART} string"
        store = self.spark.read.schema(schema).parquet(self.path)
        return (store if parts is None else store.where(F.col(_PART).isin(parts))).select(*columns)

    def upsert(self, new: DataFrame) -> list[str]:
        """Replace-into on the key; returns the partitions that were rewritten.

        ``new`` holds one row per key (``canonical_rows``).  The merged partitions are written
        aside first, as they are read from the place that they replace; a task that fails leaves the store as it was."""
        new = cut(new)
        parts = _parts(new)
        if not parts:
            return []
        merged = cut(upsert(self.rows(parts), new))
        (merged.withColumn(_PART, F.substring("url1_hash", 1, PREFIX)).repartition(_PART).sortWithinPartitions(_PART, *KEY)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.path))
        return sorted(parts)

    def scan(self, hits: DataFrame) -> DataFrame:
        """S7 from the partitions that the hits' pairs fall in."""
        smaller = hits.select(F.md5("url").alias("url1_hash"))
        return scan(self.rows(_parts(smaller)), hits)
