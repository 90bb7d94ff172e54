"""The file-in / file-out workflow end to end on CSVs derived from the smallest tables."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from credence.functions import rules
from credence.plans import flows
from credence.sources import files, testdata


def test_workflow(spark):
    d = tempfile.mkdtemp(prefix="credence-flow-")
    rv = testdata.reviews(spark, SF_SMALL)
    files.write_csv(rv.repartitionByRange(2, "pos").sortWithinPartitions("pos").drop("pos"), f"{d}/reviews")
    files.write_csv(testdata.products(spark, SF_SMALL).coalesce(1).drop("pos"), f"{d}/products")
    n = flows.prepare_contexts(spark, f"{d}/reviews", f"{d}/products", f"{d}/ctx.jsonl")
    assert n == 200
    assert flows.build_product_collection(spark, f"{d}/products", f"{d}/coll") == 200
    assert flows.build_product_collection(spark, f"{d}/products", f"{d}/coll") == 200  # upsert adds nothing
    counts = flows.pseudo_label(spark, f"{d}/ctx.jsonl", f"{d}/coll", f"{d}/labelled.jsonl", dedup=True).first()
    assert counts.total_count == 200 and counts.real_count > 0 and counts.fake_count > 0
    split = {(r.pseudo_label, r.split): r["count"] for r in
             flows.small_dataset(spark, f"{d}/labelled.jsonl", f"{d}/small.jsonl", split=True, seed=1).collect()}
    assert split[("real", "test")] >= 1 and split[("fake", "test")] >= 1
    train = spark.read.json(f"{d}/small_train.jsonl")
    test = spark.read.json(f"{d}/small_test.jsonl")
    assert train.join(test, "review_id").count() == 0
    n_fake = flows.synthesize(spark, f"{d}/labelled.jsonl", f"{d}/coll", f"{d}/fakes.jsonl", f"{d}/aug.jsonl",
                              ratio=1.0, combine_ratio=2, seed=3)
    aug = spark.read.json(f"{d}/aug.jsonl")
    assert aug.count() == 200 + n_fake
    assert aug.where(F.col("pseudo_label") == "fake").count() >= n_fake
    summary = flows.train(spark, f"{d}/small_train.jsonl", f"{d}/model", test_fraction=0.2, seed=1).first()
    assert 0.0 <= summary.accuracy <= 1.0
    assert flows.predict(spark, f"{d}/model", f"{d}/reviews", f"{d}/products", f"{d}/verdicts.jsonl") > 0
    assert {r.verdict for r in spark.read.json(f"{d}/verdicts.jsonl").select("verdict").distinct().collect()} <= {
        rules.VERDICT_USEFUL, rules.VERDICT_USELESS}
    report = flows.evaluate(spark, f"{d}/model", f"{d}/small_test.jsonl").collect()
    assert {r["class"] for r in report} >= {"accuracy", "macro avg", "weighted avg"}
