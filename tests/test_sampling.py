"""Seeded sampling, splits, ranks and running sums: exact counts and invariants."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from credence.operators import labeling, metrics, sampling


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "real" if i % 4 else "fake", str(i)) for i in range(1000)]
    return spark.createDataFrame(rows, "pos long, pseudo_label string, context string")


def test_bucketed_rank_matches_window(spark, labelled):
    # Tiny buckets force many (class, bucket) groups; ranks must equal one global window.
    monkey = sampling.TARGET_BUCKET_ROWS
    sampling.TARGET_BUCKET_ROWS = 7
    try:
        got = sampling.hash_rank(labelled, 3, "pos", ["pseudo_label"], "r")
    finally:
        sampling.TARGET_BUCKET_ROWS = monkey
    ref = labelled.withColumn("r2", F.row_number().over(
        Window.partitionBy("pseudo_label").orderBy(F.md5(F.concat(F.lit("3:"), F.col("pos").cast("string"))))))
    bad = got.join(ref, "pos").where(F.col("r") != F.col("r2")).count()
    assert bad == 0


def test_pos_rank_small_buckets(spark, labelled):
    got = sampling.pos_rank(labelled, "pos", ["pseudo_label"], "r", bucket_rows=13)
    ref = labelled.withColumn("r2", F.row_number().over(Window.partitionBy("pseudo_label").orderBy("pos")))
    assert got.join(ref, "pos").where(F.col("r") != F.col("r2")).count() == 0


def test_balanced_normal_branch(spark, labelled):
    out = sampling.balanced_dataset(labelled, 1.0, seed=1, split=True, test_ratio=0.2)
    counts = {(r.pseudo_label, r.split): r["count"] for r in out.groupBy("pseudo_label", "split").count().collect()}
    assert counts == {("real", "train"): 200, ("real", "test"): 50, ("fake", "train"): 200, ("fake", "test"): 50}
    # Fakes are split in file order: the last 50 fakes are the test part.
    fake_test = sorted(r.pos for r in out.where("pseudo_label = 'fake' AND split = 'test'").collect())
    assert fake_test == [i for i in range(1000) if i % 4 == 0][-50:]


def test_balanced_short_branch(spark, labelled):
    out = sampling.balanced_dataset(labelled, 5.0, seed=1)
    counts = {r.pseudo_label: r["count"] for r in out.groupBy("pseudo_label").count().collect()}
    assert counts == {"real": 250, "fake": 250}


def test_balanced_errors(spark, labelled):
    with pytest.raises(ValueError):
        sampling.balanced_dataset(labelled.where("pseudo_label = 'real'"), 1.0)
    with pytest.raises(ValueError):
        sampling.balanced_dataset(labelled, 1.0, split=True, test_ratio=1.5)


def test_minimum_one_test_row(spark, labelled):
    out = sampling.balanced_dataset(labelled, 1.0, seed=2, split=True, test_ratio=0.0)
    assert out.where("split = 'test'").groupBy("pseudo_label").count().collect()[0]["count"] == 1


def test_sample_and_pick(spark, labelled):
    s = sampling.sample_exact_n(labelled, {"real": 3, "fake": 1000}, seed=5)
    counts = {r.pseudo_label: r["count"] for r in s.groupBy("pseudo_label").count().collect()}
    assert counts == {"real": 3, "fake": 250}
    p = sampling.pick_examples(labelled, 2, 1, seed=5)
    assert sorted(r.pseudo_label for r in p.collect()) == ["fake", "real", "real"]
    assert sampling.pick_examples(labelled.where("pseudo_label = 'real'"), 1, 1).count() == 1  # short class


def test_random_split_stable(spark, labelled):
    a = sampling.random_split(labelled, 0.1, seed=9)
    b = sampling.random_split(labelled.repartition(7), 0.1, seed=9)
    assert a.join(b, ["pos"]).where(a.split != b.split).count() == 0
    n_test = a.where("split = 'test'").count()
    assert 50 < n_test < 150


def test_running_sums_small_buckets(spark, labelled):
    out = labeling.running_label_counts(labelled, bucket_rows=17)
    ref = labelled.withColumn("f2", F.sum(F.when(F.col("pseudo_label") == "fake", 1).otherwise(0)).over(
        Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    j = out.join(ref, "pos")
    assert j.where((F.col("fake_count") != F.col("f2")) | (F.col("total_count") != F.col("pos") + 1)).count() == 0


def test_flag_duplicates(spark):
    df = spark.createDataFrame([(0, "a", "real"), (1, "b", "real"), (2, "a", "real"), (3, None, "real"),
                                (4, "", "real")], "pos long, context string, pseudo_label string")
    got = {r.pos: (r.is_duplicate, r.pseudo_label) for r in labeling.flag_duplicates(df).collect()}
    assert got == {0: (False, "real"), 1: (False, "real"), 2: (True, "fake"), 3: (False, "real"),
                   4: (True, "fake")}  # a missing text hashes like the empty text


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0), (0, 1)], "label int, prediction int")
    rep = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rep["1"].precision == 0.6667 and rep["1"].recall == 0.6667 and rep["1"].support == 3
    assert rep["0"].precision == 0.5 and rep["0"].recall == 0.5
    assert rep["accuracy"].f1 == 0.6
    assert rep["macro avg"].f1 == round((2 / 3 + 0.5) / 2, 4)
    one_class = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    s = metrics.metrics_summary(one_class).first()
    assert s.accuracy == 1.0 and s.macro_f1 == 1.0
