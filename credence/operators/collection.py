"""A stored product collection that grows by committed batches.

``<path>/data`` holds the entries in hash buckets of their id (a partition column) with the batch
that wrote them; ``<path>/commits`` has one row per finished batch. Readers take committed batches
only, so a batch cut short by a lost job is never seen, and its repetition is a new batch. An id that
is stored is never replaced: new entries are tested against the ids of their own bucket (only the id
column is read, and only buckets that new entries fall into), so a repeated run appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_COLUMNS = ["id", "document", "metadata", "embedding"]
BUCKETS = 64


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    data, commits = _read(spark, f"{path}/data"), _read(spark, f"{path}/commits")
    if data is None or commits is None:
        return None
    return data.join(commits.select("batch"), "batch", "left_semi")


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The committed entries; fails when there are none yet."""
    stored = _committed(spark, path)
    if stored is None:
        raise FileNotFoundError(f"no committed collection in {path}")
    return stored.select(*ENTRY_COLUMNS)


def append(spark: SparkSession, path: str, entries: DataFrame, buckets: int = BUCKETS) -> int:
    """Adds the entries (distinct ids; NULL ids are refused by the caller's key) that are not stored yet;
    returns how many. ``buckets`` must stay the same for one path. One writer at a time."""
    batch = uuid.uuid4().hex
    fresh = entries.select(*ENTRY_COLUMNS).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    stored = _committed(spark, path)
    if stored is not None:
        fresh = fresh.join(stored.select("bucket", "id"), ["bucket", "id"], "left_anti")
    fresh.withColumn("batch", F.lit(batch)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data").filter(F.col("batch") == batch).count()
    if rows:
        commit = spark.createDataFrame([(batch, rows)], "batch string, rows long").coalesce(1)
        commit.write.mode("append").parquet(f"{path}/commits")
    return rows
