"""Global ranks and prefix sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm._scratch import materialize


def ordered_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds, for each entry of ``sums``, the sum of its values over all rows *before* this one.

    Rows are range-partitioned by ``order`` and written once with their partition number (the
    split points are sampled a single time), so each window covers one partition; partition
    totals (one row each) give the bases. ``order`` must be total for a defined result.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(
        df.withColumns({f"__v_{k}": v for k, v in sums.items()}).withColumn("__one", F.lit(1))
        .repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()),
        name,
    )
    totals = placed.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(bases), "__part")  # as many rows as shuffle partitions
    out = out.withColumns({k: F.col(f"__b_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in sums})
    return out.drop("__part", "__one", *[f"__v_{k}" for k in sums], *[f"__b_{k}" for k in sums])
