"""Pseudo-labelling: retrieval + fact check + heuristic score -> real/fake, and label statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import rules
from credence.functions.text import content_hash
from credence.operators.skew import attach, require_key
from credence.operators.retrieval import DEFAULT_BLOCK_BYTES, DEFAULT_DIM, Packed, embed_texts, topk_similar


def score_reviews(df: DataFrame, missing: str = "nan", strict_int: bool = True, with_price: bool = False,
                  threshold: float = rules.FAKE_THRESHOLD) -> DataFrame:
    """Given ``context, meta, retrieved``: add ``fact_label``, ``fake_score``, ``pseudo_label``.

    Re-running is a re-label: any earlier ``pseudo_label`` is overwritten. Built as three
    wide projections (parsed inputs, then fact + score, then the label) so the rule trees
    are analysed a fixed number of times."""
    base = [c for c in df.columns if c not in ("fact_label", "fake_score", "pseudo_label", "__rf", "__si")]
    ctx = F.col("context")
    staged = df.select(*base, rules.review_features(ctx, with_price).alias("__rf"),
                       rules.score_inputs(ctx, F.col("meta"), missing, strict_int).alias("__si"))
    scored = staged.select(*base, "__si",
                           rules.factual_label_from(F.col("__rf"), F.col("retrieved"), with_price).alias("fact_label"),
                           rules.score_from(F.col("__si")).alias("fake_score"))
    label = (F.when(F.col("fact_label") == "fake", F.lit("fake"))
             .when(F.col("fake_score") > F.lit(float(threshold)), F.lit("fake"))
             .when((F.length(F.coalesce(ctx, F.lit(""))) >= rules.MIN_REAL_CONTEXT_CHARS) & F.col("__si.has_rating"),
                   F.lit("real"))
             .otherwise(F.lit("fake")))
    ordered = [c for c in df.columns if c not in ("fact_label", "fake_score")]
    ordered = ordered if "pseudo_label" in ordered else ordered + ["pseudo_label"]
    out = [label.alias("pseudo_label") if c == "pseudo_label" else F.col(c) for c in ordered]
    return scored.select(*out, "fact_label", "fake_score")


def label_reviews(records: DataFrame, collection: DataFrame | Packed, k: int = 3, missing: str = "nan",
                  strict_int: bool = True, with_price: bool = False, dim: int = DEFAULT_DIM, embedder=None,
                  keep_scores: bool = True, keep_dist: bool = False,
                  max_block_bytes: int = DEFAULT_BLOCK_BYTES) -> DataFrame:
    """Label every context record: embed its context, retrieve the k nearest products,
    check facts, score, decide. Output = record + ``retrieved`` + ``pseudo_label``
    (+ ``fact_label``, ``fake_score`` when ``keep_scores``)."""
    q = embed_texts(records, "context", "__qvec", dim=dim, embedder=embedder)
    r = topk_similar(q, collection, k=k, vec_col="__qvec", keep_dist=keep_dist, max_block_bytes=max_block_bytes)
    out = score_reviews(r.drop("__qvec"), missing=missing, strict_int=strict_int, with_price=with_price)
    if not keep_scores:
        out = out.drop("fact_label", "fake_score")
    return out


def flag_duplicates(df: DataFrame, col: str = "context", pos: str = "pos", label_col: str = "pseudo_label") -> DataFrame:
    """Later copies of an identical text become ``fake``; the first occurrence keeps its label.

    Adds ``is_duplicate``. ``pos`` must be unique and not NULL. First positions come from a
    grouped ``min`` joined back on (hash, salt): the copies of a text repeated millions of
    times are dealt over many tasks."""
    h = require_key(df, pos).withColumn("__h", content_hash(F.col(col)))
    out = attach(h, ["__h"], F.col(pos), {"__m": F.min(pos)}, {"__first": F.min("__m")})
    dup = F.col(pos) != F.col("__first")
    out = out.withColumn("is_duplicate", dup)
    if label_col in df.columns:
        out = out.withColumn(label_col, F.when(dup, F.lit("fake")).otherwise(F.col(label_col)))
    return out.drop("__h", "__first")


def write_duplicate_split(flagged: DataFrame, path: str) -> None:
    """One write of flagged records in two partitions, kept and duplicate rows. Only the partitions that
    this run has rows for are replaced (dynamic partition overwrite)."""
    flagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("is_duplicate").parquet(path)


def read_duplicate_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all records, duplicates relabelled; the duplicates alone) of a written split: the second reads
    its partition only."""
    stored = spark.read.parquet(path)
    return split_duplicates(stored.withColumn("is_duplicate", F.col("is_duplicate").cast("boolean")))


def split_duplicates(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all records with duplicates relabelled, the duplicates alone)."""
    return flagged.drop("is_duplicate"), flagged.where(F.col("is_duplicate")).drop("is_duplicate")


def label_counts(df: DataFrame, label_col: str = "pseudo_label") -> DataFrame:
    """One row: ``real_count, fake_count, total_count`` (anything not ``fake`` counts as real)."""
    is_fake = F.coalesce(F.col(label_col) == "fake", F.lit(False))
    return df.agg(
        F.count_if(~is_fake).alias("real_count"),
        F.count_if(is_fake).alias("fake_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def running_sums(df: DataFrame, order_col: str, values: dict, bucket_rows: int = 1 << 20) -> DataFrame:
    """Running totals in ``order_col`` order without a single-partition window.

    Rows are cut into ranges of ``bucket_rows`` positions; per-range totals (one row per
    range, tiny) give each range its offset through a window over the ranges, and a
    window partitioned by range adds the in-range running sum. ``values`` maps output
    name -> numeric Column."""
    bucket = F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("bigint")
    base = require_key(df, order_col).withColumn("__b", bucket)
    for name, c in values.items():
        base = base.withColumn(f"__v_{name}", c.cast("bigint"))
    totals = base.groupBy("__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    prior = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", *[F.coalesce(F.sum(f"__t_{n}").over(prior), F.lit(0)).alias(f"__o_{n}")
                                     for n in values])
    within = Window.partitionBy("__b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Shuffled join on the range id: the window below needs the same partitioning, so the
    # big side moves once. Ranges hold ``bucket_rows`` positions each, so no range is hot.
    out = base.join(offsets, "__b", "left")
    for n in values:
        out = out.withColumn(n, F.sum(f"__v_{n}").over(within) + F.col(f"__o_{n}"))
    return out.drop("__b", *[f"__v_{n}" for n in values], *[f"__o_{n}" for n in values])


def running_label_counts(df: DataFrame, pos: str = "pos", label_col: str = "pseudo_label",
                         bucket_rows: int = 1 << 20) -> DataFrame:
    """Per row, the real/fake/total counts of all rows up to it in ``pos`` order."""
    is_fake = F.coalesce(F.col(label_col) == "fake", F.lit(False))
    return running_sums(df, pos, {
        "real_count": F.when(is_fake, 0).otherwise(1),
        "fake_count": F.when(is_fake, 1).otherwise(0),
        "total_count": F.lit(1),
    }, bucket_rows)


def distinct_by_text(df: DataFrame, col: str = "context", pos: str = "pos") -> DataFrame:
    """First occurrence of every text (later identical copies removed)."""
    return flag_duplicates(df, col, pos, label_col="__none").where(~F.col("is_duplicate")).drop("is_duplicate")
