"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from credence.session import checkpoint_dir


def folder(spark, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/credence-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage,
    survives lost executors and is read by column. (``checkpoint()`` would run the last stage
    twice and store whole rows uncompressed.)"""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
