"""Explicit schemas. Every source column is STRING; numeric meaning is applied by safe casts."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Column names of the review export that the pipeline reads.
REVIEW_COLUMNS = [
    "review_id", "product_id", "author_id", "rating", "is_recommended", "helpfulness",
    "total_feedback_count", "total_neg_feedback_count", "total_pos_feedback_count",
    "review_text", "review_title",
    "submission_time", "skin_tone", "eye_color", "skin_type", "hair_color",
]

# The review fields copied into the record's nested ``meta``, in output order.
META_FIELDS = [
    "author_id", "rating", "is_recommended", "helpfulness",
    "total_feedback_count", "total_neg_feedback_count", "total_pos_feedback_count",
]

# Product columns read from the product table.
PRODUCT_COLUMNS = [
    "product_id", "product_name", "brand_id", "brand_name", "rating", "reviews", "size",
    "price_usd", "value_price_usd", "sale_price_usd", "online_only", "highlights",
]

# Product metadata keys stored with each collection entry, in order.
PRODUCT_META_FIELDS = [
    "product_id", "product_name", "brand_id", "brand_name", "rating", "reviews", "size",
    "price_usd", "value_price_usd", "sale_price_usd", "online_only", "highlights",
]


def strings(names) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


META_SCHEMA = strings(META_FIELDS)
PRODUCT_META_SCHEMA = strings(PRODUCT_META_FIELDS)

REVIEW_CSV_SCHEMA = strings(REVIEW_COLUMNS)
PRODUCT_CSV_SCHEMA = strings(PRODUCT_COLUMNS)

RETRIEVED_SCHEMA = ArrayType(
    StructType([
        StructField("id", StringType(), True),
        StructField("document", StringType(), True),
        StructField("metadata", PRODUCT_META_SCHEMA, True),
    ])
)

# Context record (one JSON line per review).
CONTEXT_RECORD_SCHEMA = StructType([
    StructField("review_id", StringType(), True),
    StructField("product_id", StringType(), True),
    StructField("context", StringType(), True),
    StructField("meta", META_SCHEMA, True),
    StructField("pseudo_label", StringType(), True),
])

LABELLED_RECORD_SCHEMA = StructType(
    CONTEXT_RECORD_SCHEMA.fields + [StructField("retrieved", RETRIEVED_SCHEMA, True)]
)

# Product collection entry.
COLLECTION_SCHEMA = StructType([
    StructField("id", StringType(), False),
    StructField("document", StringType(), True),
    StructField("metadata", PRODUCT_META_SCHEMA, True),
    StructField("embedding", ArrayType(FloatType(), False), True),
])

# Synthetic record: labelled record whose ``meta`` is the union of review meta and product
# metadata keys, plus top-level random review info.
SYNTH_META_FIELDS = META_FIELDS + [f for f in PRODUCT_META_FIELDS if f not in META_FIELDS]
SYNTH_INFO_SCHEMA = StructType([
    StructField("rating", IntegerType(), True),
    StructField("is_recommended", IntegerType(), True),
    StructField("total_feedback_count", IntegerType(), True),
    StructField("total_pos_feedback_count", IntegerType(), True),
    StructField("total_neg_feedback_count", IntegerType(), True),
    StructField("helpfulness", DoubleType(), True),
    StructField("review_title", StringType(), True),
])

CLASSIFIER_EXAMPLE_SCHEMA = StructType([
    StructField("text", StringType(), True),
    StructField("label", IntegerType(), True),
])

PREDICTION_SCHEMA = StructType([
    StructField("label", IntegerType(), True),
    StructField("prediction", IntegerType(), True),
])

CAPACITY_SCHEMA = ArrayType(StructType([
    StructField("amount", DoubleType(), True),
    StructField("unit", StringType(), True),
]))

POS_FIELD = StructField("pos", LongType(), False)
