"""End-to-end: entry contract, streaming equals batch, registered queries vs DuckDB oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from credence.plans import catalog

FAST_KEYS = ["label_reviews", "topk_similar_products", "build_context", "balanced_dataset", "stratified_split",
             "flag_duplicates", "classification_report", "running_label_counts", "augment_text", "pair_real_fake",
             "explain_reviews", "scan_reviews_csv", "sort_products", "parse_context", "fake_score", "label_counts",
             "metrics_summary", "text_norm", "random_review_info", "safe_casts", "distinct_texts",
             "encode_labels_strict", "encode_labels_lenient", "synth_fakes", "evaluate_explainer",
             "build_request_context", "retrieval_rank", "upsert_products", "duplicate_split_files", "model_roundtrip",
             "token_model", "evaluate_token_model", "predict_token_model"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["review_id", "pseudo_label", "fact_label", "fake_score"]
    rows = df.collect()
    assert len(rows) == 200 and {r.pseudo_label for r in rows} <= {"real", "fake"}


def test_every_query_has_oracle_or_is_learned_or_approximate():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    learned = {"train_classifier", "evaluate_classifier", "predict_requests", "topk_similar_lsh"}
    assert set(catalog.QUERIES) <= set(q) and set(catalog.QUERIES) - set(o) == learned


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("inf" if math.isinf(v) else round(v, 6))
    return v


@pytest.mark.parametrize("key", FAST_KEYS)
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in ["part", "documents", "embeddings", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = entry.queries()[key](spark, SF_SMALL)
    rel = con.sql(entry.oracle_sql()[key])
    spark_types = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
                   "boolean": "BOOLEAN", "float": "FLOAT"}
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: spark_types.get(t, t) for c, t in sdf.dtypes} == duck_types
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(names)
    order = sorted(names)
    s_rows = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    d_rows = sorted((tuple(_norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert s_rows == d_rows


def test_synthetic_job_invariants(spark):
    out = entry.queries()["synth_fakes"](spark, SF_SMALL)
    rows = out.collect()
    assert rows and all(r.pseudo_label == "fake" for r in rows)
    assert all(r.total_pos_feedback_count + r.total_neg_feedback_count == r.total_feedback_count for r in rows)
    kinds = {r.kind for r in rows}
    assert "generated" in kinds and "combined" in kinds
    gen = [r for r in rows if r.kind == "generated"]
    assert all(r.context.startswith("Review title: ") and r.meta_product_name for r in gen)


def test_classifier_learns_separable_fixture(spark):
    from pyspark.sql import functions as F

    from credence.operators import models

    rows = [(i, ("great wonderful lovely " if i % 2 else "awful broken scam ") * 3, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, text string, label int")
    model, summary = models.train_classifier(df, test_fraction=0.25, seed=3)
    s = summary.first()
    assert s.accuracy > 0.95 and s.n > 50
    rep = models.evaluate_classifier(model, df.withColumn("pseudo_label", F.when(F.col("label") == 1, "real")
                                                          .otherwise("fake")).withColumnRenamed("text", "context"))
    assert {r["class"] for r in rep.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}


def test_stream_equals_batch(spark):
    batch = {r.review_id: (r.pseudo_label, r.fake_score) for r in entry.queries()["label_reviews"](spark, SF_SMALL)
             .collect()}
    stream = {r.review_id: (r.pseudo_label, r.fake_score) for r in
              entry.queries()["stream_label_reviews"](spark, SF_SMALL).collect()}
    assert stream == batch
