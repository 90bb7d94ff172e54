import random

import pytest

from credence.sources import files


@pytest.mark.parametrize("buckets", [4096, 3])
def test_prefix_of_sparse_positions(spark, monkeypatch, buckets):
    monkeypatch.setattr(files, "_PREFIX_BUCKETS", buckets)
    positions = random.Random(4).sample(range(-(10**12), 10**12), 50) + [-(2**61), 2**61] + list(range(7, 60))
    df = spark.createDataFrame([(p, str(p)) for p in positions], "pos long, t string").repartition(3)
    for n in (1, 2, 17, len(positions) - 1, len(positions), len(positions) + 5):
        assert sorted(r.pos for r in files.limit_prefix(df, n).collect()) == sorted(positions)[:n]


def test_prefix_filter_reaches_the_scan(spark, tmp_path):
    """Only a pushed filter on the stored position: no sort, no window, no shuffle."""
    spark.range(0, 20_000, 1, 4).selectExpr("id AS pos", "cast(id AS string) AS t").write.parquet(f"{tmp_path}/t")
    first = files.limit_prefix(spark.read.parquet(f"{tmp_path}/t"), 100)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(pos,99)" in plan and "Exchange" not in plan and "Window" not in plan
    assert first.count() == 100


def test_prefix_refuses_null_positions_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "pos long")
    with pytest.raises(Exception, match="must not be NULL"):
        files.limit_prefix(df, 1).collect()
    assert files.limit_prefix(df.limit(0), 5).count() == 0
