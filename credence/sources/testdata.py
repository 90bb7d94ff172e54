"""Adapter views over the driver's parquet tables.

The driver tables hold no reviews or products, so these views derive them
deterministically from *whole* tables: every ``part`` row is a product, every
``documents`` row is a review whose text is the *whole* document text plus one
planted phrase (sizes, skin words, store purchase, ...) so that every rule has
something to find. Attributes are derived from the row key; nothing is filtered,
capped or truncated, so the work grows with the tables.

The same views are written in SQL in ``credence.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        v = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product table (all STRING columns, like the raw product CSV) plus row index ``pos``."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = F.floor("p_retailprice").cast("bigint")
    size = _case(k % 5, {
        0: F.lit(None).cast("string"),
        1: F.concat(F.lit("1.7 oz/ "), _s(F.col("p_size")), F.lit(" mL")),
        2: F.concat(_s(F.col("p_size")), F.lit(" ml")),
        3: F.concat(_s(F.col("p_size") * 10), F.lit(" g")),
    }, F.concat(_s(F.col("p_size")), F.lit(" oz")))
    highlights = _case(k % 6, {
        0: F.lit(None).cast("string"),
        1: "[Good for: Dryness, Vegan]",
        2: "[best for dry skin]",
        3: "[best for oily skin]",
        4: "[Treatment for women]",
    }, "[unisex, Clean]")
    return p.select(
        k.alias("pos"),
        F.concat(F.lit("P"), _s(k)).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).alias("brand_id"),
        F.col("p_brand").alias("brand_name"),
        _s(1 + k % 5).alias("rating"),
        _s(k % 100).alias("reviews"),
        size.alias("size"),
        _s(price).alias("price_usd"),
        F.when(k % 3 == 0, _s(price + 10)).alias("value_price_usd"),
        F.when(k % 4 == 0, _s(price - 5)).alias("sale_price_usd"),
        _case(k % 4, {0: F.lit(None).cast("string"), 1: "1"}, "0").alias("online_only"),
        highlights.alias("highlights"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review table (all STRING columns, like the raw review CSV) plus row index ``pos``."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    tfc = k % 31
    neg = F.floor(tfc * (k % 3) / F.lit(2.0)).cast("bigint")
    suffix = _case(k % 8, {
        0: "", 1: " my oily skin", 2: " so dry", 3: " the 25 ml jar", 4: " a 200 ml tube and 1.7 fl oz",
        5: " bought in store", 6: " great for men",
    }, " 5 great")
    return d.select(
        k.alias("pos"),
        _s(k).alias("review_id"),
        F.when(k % 11 == 0, F.lit("P-none")).otherwise(F.concat(F.lit("P"), _s(k))).alias("product_id"),
        F.concat(F.lit("A"), _s(k % 50)).alias("author_id"),
        F.when(k % 13 != 0, _s(1 + k % 5)).alias("rating"),
        _case(k % 4, {0: "1.0", 1: "0", 2: "1"}).alias("is_recommended"),
        _case(k % 6, {0: F.lit(None).cast("string"), 1: "0.1", 2: "0.25", 3: "0.5"}, "0.9").alias("helpfulness"),
        _s(tfc).alias("total_feedback_count"),
        _s(neg).alias("total_neg_feedback_count"),
        _s(tfc - neg).alias("total_pos_feedback_count"),
        F.when(k % 3 != 0, F.concat(F.lit("Title "), _s(k % 9))).alias("review_title"),
        F.concat(F.col("text"), suffix).alias("review_text"),
    )


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows independent of retrieval: ``labels.quality`` 1 -> real, 0 -> fake,
    with the document text as context; ``toxic = 0`` serves as a prediction (1 = real)."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lab.join(docs, "doc_id", "inner").select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("text").alias("context"),
        F.when(F.col("quality") == 1, F.lit("real")).otherwise(F.lit("fake")).alias("pseudo_label"),
        F.when(F.col("quality") == 1, 1).otherwise(0).cast("int").alias("label"),
        F.when(F.col("toxic") == 0, 1).otherwise(0).cast("int").alias("prediction"),
    )
