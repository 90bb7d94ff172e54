"""End-to-end jobs composed from the operators (each returns a lazy DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.operators import labeling, records
from credence.sources import testdata


def context_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 on the test tables: reviews joined with product summaries into context records."""
    return records.review_records(testdata.reviews(spark, sf_dir), testdata.products(spark, sf_dir))


def product_collection(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Stage 2 on the test tables: product documents, metadata and vectors."""
    return records.build_collection(testdata.products(spark, sf_dir), **kw)


def pseudo_labels(spark: SparkSession, sf_dir: str, k: int = 3, **kw) -> DataFrame:
    """Stage 3 on the test tables: every review labelled real/fake."""
    return labeling.label_reviews(context_records(spark, sf_dir), product_collection(spark, sf_dir), k=k, **kw)
