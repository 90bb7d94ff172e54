"""Seeded sampling, balancing and train/test splits.

Randomness is a pure function of ``(seed, key)`` (``md5('<seed>:<key>')``), so results
are reproducible, identical after a task retry, and checkable in SQL.

Exact ranks within a class never use a window over the whole class (a class can hold
a third of all rows). ``bucketed_rank`` cuts each class into buckets of bounded size
along the order key itself (the md5 key is uniform; positions are cut into ranges),
counts rows per (class, bucket) -- a table of at most classes x buckets rows -- turns
the counts into offsets, and ranks rows inside each bucket with a window over that
bucket only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.text import seeded_key
from credence.operators.skew import require_key

TARGET_BUCKET_ROWS = 1 << 20


def _n_buckets(total: int, target: int = TARGET_BUCKET_ROWS) -> int:
    return max(1, math.ceil(total / max(1, target)))


def bucketed_rank(df: DataFrame, part_cols: list[str], order_cols: list[str], bucket: Column,
                  out_col: str = "rank") -> DataFrame:
    """1-based rank of each row in ``order_cols`` order within ``part_cols``.

    ``bucket`` must be non-decreasing in the order (a coarse prefix of the order key)."""
    b = df.withColumn("__bk", bucket)
    counts = b.groupBy(*part_cols, "__bk").agg(F.count(F.lit(1)).alias("__cnt"))
    prior = Window.orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    if part_cols:
        prior = Window.partitionBy(*part_cols).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(c).alias(f"__p{i}") for i, c in enumerate(part_cols)]
    offsets = counts.select(*renamed, F.col("__bk").alias("__ob"),
                            F.coalesce(F.sum("__cnt").over(prior), F.lit(0)).alias("__off"))
    cond = [F.col("__bk") == F.col("__ob")] + [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(part_cols)]
    joined = b.join(offsets, cond, "left").drop("__ob", *[f"__p{i}" for i in range(len(part_cols))])
    within = Window.partitionBy(*part_cols, "__bk").orderBy(*order_cols)
    return joined.withColumn(out_col, F.row_number().over(within) + F.col("__off")).drop("__bk", "__off")


BUCKETS_PER_CORE = 8


def hash_rank(df: DataFrame, seed: int, key: str, part_cols: list[str] | None = None, out_col: str = "rank",
              total: int | None = None) -> DataFrame:
    """Rank rows by ``md5('<seed>:<key>')`` within ``part_cols`` (a seeded shuffle order).

    The md5 key is uniform, so buckets cut along it are even. Without a known ``total``
    the bucket count follows the cluster (several buckets per core), so no counting pass
    over the input is needed; with one, buckets hold at most ``TARGET_BUCKET_ROWS`` rows."""
    part_cols = part_cols or []
    per_cluster = df.sparkSession.sparkContext.defaultParallelism * BUCKETS_PER_CORE
    nb = _n_buckets(total) if total is not None else per_cluster
    h = require_key(df, key).withColumn("__hk", seeded_key(seed, key))
    bucket = F.floor(F.conv(F.substring("__hk", 1, 8), 16, 10).cast("bigint") * F.lit(nb) / F.lit(4294967296.0))
    return bucketed_rank(h, part_cols, ["__hk"], bucket.cast("bigint"), out_col).drop("__hk")


def pos_rank(df: DataFrame, pos: str = "pos", part_cols: list[str] | None = None, out_col: str = "rank",
             bucket_rows: int = TARGET_BUCKET_ROWS) -> DataFrame:
    """Rank rows by position (file order) within ``part_cols``."""
    bucket = F.floor(F.col(pos) / F.lit(bucket_rows)).cast("bigint")
    return bucketed_rank(require_key(df, pos), part_cols or [], [pos], bucket, out_col)


def shuffle_rows(df: DataFrame, seed: int, key: str = "pos") -> DataFrame:
    """Seeded shuffle: adds ``shuffle_rank`` (1-based position in the shuffled order)."""
    return hash_rank(df, seed, key, out_col="shuffle_rank")


def sample_exact_n(df: DataFrame, n: int | dict, seed: int, key: str = "pos", by: str | None = "pseudo_label",
                   rank_col: str = "sample_rank", total: int | None = None) -> DataFrame:
    """Exactly ``n`` rows per class (or ``n[class]``; fewer if the class is smaller),
    without replacement, chosen by the seeded order. Keeps ``sample_rank``. ``total``
    (row count, when already known) saves the counting pass that sizes the buckets."""
    parts = [by] if by else []
    ranked = hash_rank(df, seed, key, parts, rank_col, total=total)
    if isinstance(n, dict):
        limit = None
        for cls, m in n.items():
            cond = (F.col(by) == F.lit(cls)) & (F.col(rank_col) <= F.lit(int(m)))
            limit = cond if limit is None else (limit | cond)
        return ranked.where(limit if limit is not None else F.lit(False))
    return ranked.where(F.col(rank_col) <= F.lit(int(n)))


def class_counts(df: DataFrame, label_col: str = "pseudo_label") -> tuple[int, int]:
    """(real, fake) counts -- one small aggregate, returned as two numbers."""
    row = df.agg(F.count_if(F.col(label_col) == "real").alias("r"), F.count_if(F.col(label_col) == "fake").alias("f")).first()
    return int(row["r"]), int(row["f"])


def balanced_dataset(df: DataFrame, ratio_real_to_fake: float = 1.0, seed: int = 0, key: str = "pos",
                     label_col: str = "pseudo_label", split: bool = False, test_ratio: float = 0.2,
                     pos: str = "pos") -> DataFrame:
    """Balanced real/fake set; with ``split`` an extra ``split`` column (``train``/``test``).

    Normal branch (enough real rows): ``n = max(int(fakes * ratio), 1)`` real rows sampled,
    all fakes kept; the test part of the fakes is the last ``n_test`` in file order.
    Short branch (``real < fakes * ratio``): ``min(real, fake)`` sampled from each class.
    Every class puts ``max(int(n * test_ratio), 1)`` rows into test: the last ones in the
    sampled order. Adds ``sample_rank`` (order within its class)."""
    if split and not (0.0 <= test_ratio <= 1.0):
        raise ValueError("test_ratio must be between 0.0 and 1.0")
    labelled = df.where(F.col(label_col).isin("real", "fake"))
    real, fake = class_counts(labelled, label_col)
    if fake == 0:
        raise ValueError("No fake reviews found in the dataset.")
    if real == 0:
        raise ValueError("No real reviews found in the dataset.")
    if real < fake * ratio_real_to_fake:
        m = min(real, fake)
        sizes = {"real": m, "fake": m}
        out = sample_exact_n(labelled, sizes, seed, key, label_col, total=real + fake)
    else:
        m = max(int(fake * ratio_real_to_fake), 1)
        sizes = {"real": m, "fake": fake}
        reals = sample_exact_n(labelled.where(F.col(label_col) == "real"), m, seed, key, label_col, total=real)
        fakes = pos_rank(labelled.where(F.col(label_col) == "fake"), pos, [label_col], "sample_rank")
        out = reals.unionByName(fakes)
    if not split:
        return out
    n_test = {c: max(int(s * test_ratio), 1) for c, s in sizes.items()}
    is_test = None
    for c, s in sizes.items():
        cond = (F.col(label_col) == c) & (F.col("sample_rank") > F.lit(s - n_test[c]))
        is_test = cond if is_test is None else (is_test | cond)
    return out.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def random_split(df: DataFrame, test_fraction: float = 0.1, seed: int = 0, key: str = "pos") -> DataFrame:
    """Unstratified split by a seeded uniform draw per row: adds ``split``.

    Unlike ``randomSplit`` it does not depend on partitioning, so a retried task or a
    re-read gives the same split."""
    h = F.md5(F.concat(F.lit(f"{seed}:split:"), F.col(key).cast("string")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return require_key(df, key).withColumn("split", F.when(u < F.lit(test_fraction), F.lit("test")).otherwise(F.lit("train")))


def pick_examples(df: DataFrame, real_num: int = 1, fake_num: int = 1, seed: int = 0, key: str = "pos",
                  label_col: str = "pseudo_label") -> DataFrame:
    """``real_num`` real and ``fake_num`` fake rows at random (fewer when a class is short);
    output ``context, pseudo_label, record`` (the whole row as JSON)."""
    picked = sample_exact_n(df.where(F.col(label_col).isin("real", "fake")),
                            {"real": real_num, "fake": fake_num}, seed, key, label_col)
    rec = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return picked.select(F.col(key), F.col("context"), F.col(label_col), rec.alias("record"))
