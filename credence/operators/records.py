"""Review records and the product collection: lookups, context records, collection upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import context as ctx
from credence.operators.retrieval import DEFAULT_DIM, embed_texts
from credence.operators.skew import spread_lookup
from credence.schemas import PRODUCT_COLUMNS
from credence.session import checkpoint_dir


def latest_per_key(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row per key: the one with the highest position (a dict overwritten in file order).

    A grouped ``max_by`` (partial aggregation before the shuffle), not a window: a hot
    key is pre-aggregated map-side instead of landing whole in one task."""
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in others])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(packed, F.col(pos)).alias("__row"))
        .select(key, "__row.*")
    )


def product_summaries(products: DataFrame) -> DataFrame:
    """``product_id -> product summary``; duplicate ids keep the last row."""
    summ = products.select("product_id", "pos", ctx.product_summary(products).alias("product_summary"))
    return latest_per_key(summ, "product_id").select("product_id", "product_summary")


def join_product_summary(reviews: DataFrame, products: DataFrame | None) -> DataFrame:
    """Left equi-join of reviews to product summaries; never multiplies review rows.

    The summary side has one row per product and is repeated over the salts that the product's
    reviews have, so a hot product's reviews are met by several tasks. It grows with the reviews, so it is
    shuffled whatever the broadcast threshold."""
    if products is None:
        return reviews.withColumn("product_summary", F.lit(None).cast("string"))
    spread = F.col("pos") if "pos" in reviews.columns else F.struct(*reviews.columns)
    return spread_lookup(reviews, product_summaries(products), "product_id", spread, shuffled=True)


def reviews_with_known_product(reviews: DataFrame, products: DataFrame, known: bool = True) -> DataFrame:
    """Left-semi (or anti) membership of a review's product in the product table."""
    return reviews.join(products.select("product_id").where(F.col("product_id").isNotNull()), "product_id",
                        "left_semi" if known else "left_anti")


def review_records(reviews: DataFrame, products: DataFrame | None) -> DataFrame:
    """Context records: ``review_id, product_id, context, meta{7}, pseudo_label=NULL`` (+ ``pos``)."""
    joined = join_product_summary(reviews, products)
    rid = F.col("review_id") if "review_id" in joined.columns else F.lit(None).cast("string")
    return joined.select(
        F.when(rid != "", rid).alias("review_id"),
        (F.col("product_id") if "product_id" in joined.columns else F.lit(None).cast("string")).alias("product_id"),
        ctx.context_text(joined).alias("context"),
        ctx.review_meta(joined).alias("meta"),
        F.lit(None).cast("string").alias("pseudo_label"),
        (F.col("pos") if "pos" in joined.columns else F.lit(None).cast("long")).alias("pos"),
    )


def product_entries(products: DataFrame) -> DataFrame:
    """Collection entries without vectors: ``id, document, metadata`` (+ ``pos``).

    Missing values are filled with ``""`` first, so every existing column prints its part."""
    present = [c for c in PRODUCT_COLUMNS if c in products.columns]
    filled = products.na.fill("", subset=present)
    pid = ctx.product_id_default("product_id", "pos")
    return filled.select(
        pid.alias("id"),
        ctx.product_document(filled).alias("document"),
        ctx.product_metadata(filled, pid).alias("metadata"),
        F.col("pos"),
    )


def build_collection(products: DataFrame, dim: int = DEFAULT_DIM, embedder=None) -> DataFrame:
    """Collection entries with ``embedding`` of the document text. Duplicate ids keep the
    first row (an id already stored is never replaced)."""
    entries = product_entries(products)
    first = latest_per_key(entries.withColumn("__neg", -F.col("pos")), "id", "__neg").drop("__neg")
    return embed_texts(first, "document", "embedding", dim=dim, embedder=embedder)


def sort_products(products: DataFrame, partitions: int | None = None) -> DataFrame:
    """Products by name (missing names last, ties by id) with ``name_rank``.

    A global rank without a single-task window: range-partition on the sort key, write the
    rows once with their range number (a second run could sample other split points), count
    rows per range, offset, then rank inside each range."""
    from credence.operators.sampling import bucketed_rank

    n = partitions or products.sparkSession.sparkContext.defaultParallelism
    ranged = products.repartitionByRange(n, F.asc_nulls_last("product_name"), F.asc("product_id"))
    checkpoint_dir(products.sparkSession)
    ranged = ranged.withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    return bucketed_rank(ranged, [], [F.asc_nulls_last("product_name"), F.asc("product_id")], F.col("__part"),
                         "name_rank").drop("__part")


def first_product_per_name(products: DataFrame) -> DataFrame:
    """One product per name: the first in name-then-file order (a grouped ``min_by``)."""
    packed = F.struct(*[F.col(c) for c in products.columns if c != "product_name"])
    return (products.where(F.col("product_name").isNotNull()).groupBy("product_name")
            .agg(F.min_by(packed, F.col("pos")).alias("__p")).select("product_name", "__p.*"))


def request_contexts(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Form-style contexts for a table of requests (title, text, product name, recommended
    flag), filled with the chosen product's rating, brand and highlights."""
    names = latest_per_key(products.select("product_id", "pos", "product_name"), "product_id").select(
        F.col("product_id").alias("__pid"), F.col("product_name").alias("req_product_name"))
    # Shuffled joins: a product file of a few MB may hold millions of rows, too many for the driver.
    req = reviews.join(names.hint("merge"), reviews["product_id"] == names["__pid"], "left").select(
        "review_id", "review_title", "review_text", "req_product_name",
        (F.expr("try_cast(is_recommended AS double)") == 1).alias("recommended"))
    first = first_product_per_name(products).select(
        F.col("product_name").alias("req_product_name"), F.col("rating").alias("p_rating"),
        F.col("brand_name").alias("p_brand"), F.col("highlights").alias("p_highlights"))
    j = req.join(first.hint("merge"), "req_product_name", "inner")
    return j.select("review_id", ctx.request_context(
        F.col("review_title"), F.col("review_text"), F.col("recommended"), F.col("p_rating"),
        F.col("req_product_name"), F.col("p_brand"), F.col("p_highlights")).alias("context"))
