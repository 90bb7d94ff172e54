"""One unique, non-null position end to end: records without one, headers, sorts, augmented sets."""

import json
import os

import pytest
from conftest import SF_SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from credence.operators import augment, labeling, records, retrieval, sampling
from credence.plans import catalog, flows, jobs
from credence.schemas import LABELLED_RECORD_SCHEMA
from credence.sources import files, testdata


def write_records(path, n):
    os.makedirs(path)
    for part in range(3):
        with open(os.path.join(path, f"p{part}.json"), "w") as f:
            for i in range(part * n // 3, (part + 1) * n // 3):
                label = "fake" if i % 3 == 0 else "real"
                f.write(json.dumps({"review_id": f"r{i}", "context": f"text {i}", "pseudo_label": label}) + "\n")


def test_split_records_without_position(spark, tmp_path):
    write_records(str(tmp_path / "in"), 60)
    recs = files.read_jsonl(spark, str(tmp_path / "in"), LABELLED_RECORD_SCHEMA, pos_col="pos")
    assert [r.review_id for r in recs.orderBy("pos").collect()] == [f"r{i}" for i in range(60)]
    counts = {(r.pseudo_label, r.split): r["count"] for r in flows.small_dataset(spark, str(tmp_path / "in"), str(tmp_path / "out.jsonl"), split=True).collect()}
    assert counts == {("real", "train"): 16, ("real", "test"): 4, ("fake", "train"): 16, ("fake", "test"): 4}
    assert spark.read.json(str(tmp_path / "out_test.jsonl")).count() == 8
    assert len(files.read_jsonl(spark, str(tmp_path / "in"), LABELLED_RECORD_SCHEMA, max_rows=7).collect()) == 7


@pytest.mark.parametrize("job", [
    lambda d: sampling.shuffle_rows(d, 1), lambda d: sampling.random_split(d), lambda d: sampling.pos_rank(d),
    lambda d: labeling.flag_duplicates(d), lambda d: labeling.running_label_counts(d)])
def test_null_positions_are_refused(spark, job):
    df = spark.createDataFrame([(1, "a", "real"), (None, "b", "fake")], "pos long, context string, pseudo_label string")
    with pytest.raises(PySparkException, match="must not be NULL"):
        job(df).collect()


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "reviews_a.csv").write_text("review_id,rating,review_text\na,5,hello\n")
    (tmp_path / "reviews_b.csv").write_text("review_id,review_text,rating\nb,bye,1\n")
    (tmp_path / "reviews_c.csv").write_text("review_text,review_id\nonly,c\n")
    rows = files.read_reviews_csv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.review_id, r.rating, r.review_text) for r in rows] == [("a", "5", "hello"), ("b", "1", "bye"), ("c", None, "only")]
    assert [r.pos for r in rows] == [0, files.POS_STRIDE, 2 * files.POS_STRIDE]


def test_sort_products_ranks_are_dense(spark):
    out = records.sort_products(testdata.products(spark, "/root/testdata/sf0.1"), partitions=16)
    n, distinct, high = out.agg(F.count("*"), F.countDistinct("name_rank"), F.max("name_rank")).first()
    assert n == distinct == high == 20_000 and len(out.columns) == 14


def test_augmented_set_is_relabelled_whole(spark):
    base = catalog._qlabels(spark, SF_SMALL).withColumn("meta", F.struct(*[F.lit(None).cast("string").alias(f) for f in augment.META_FIELDS]))
    coll = jobs.product_collection(spark, SF_SMALL)
    syn = augment.synth_fakes(base, coll, ratio=1.0, seed=3, combine_ratio=2, troll=True)
    both = augment.augment_union(base, syn, 3)
    n, positions = both.agg(F.count("*"), F.countDistinct("pos")).first()
    assert n == positions and both.filter("pos IS NULL").count() == 0
    one = labeling.label_reviews(both, coll)
    four = labeling.label_reviews(both, coll, max_block_bytes=retrieval.collection_stats(coll)["bytes"] // 4)
    pick = lambda d: sorted((r.pos, r.pseudo_label, tuple(x.id for x in r.retrieved)) for r in d.collect())
    assert pick(one) == pick(four) and len(pick(one)) == n
    copies = syn.filter("kind = 'duplicate'").count()
    flagged = labeling.flag_duplicates(both)
    assert flagged.filter("kind = 'duplicate' AND NOT is_duplicate").count() == 0 and copies >= 0


def test_request_contexts_flag_and_repeated_products(spark):
    reviews = spark.createDataFrame([("r1", "t", "x", "P1", "1.0"), ("r2", "t", "x", "P1", "0.0"), ("r3", "t", "x", "P1", "1"), ("r4", "t", "x", "P1", None)],
                                    "review_id string, review_title string, review_text string, product_id string, is_recommended string")
    products = spark.createDataFrame([(0, "P1", "N", "4", "B", "h"), (1, "P1", "N", "4", "B", "h")], "pos long, product_id string, product_name string, rating string, brand_name string, highlights string")
    got = {r.review_id: r.context for r in records.request_contexts(reviews, products).collect()}
    assert len(got) == 4
    assert {k: v.split("Recommended: ")[1][:3] for k, v in got.items()} == {"r1": "1.0", "r2": "0.0", "r3": "1.0", "r4": "0.0"}
