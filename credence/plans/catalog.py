"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per inventory key.

Every query reads the given tables (through the adapter views of
``credence.sources.testdata``) in full, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import context as ctxf
from credence.functions import rules
from credence.functions import text as tx
from credence.operators import labeling, lsh, records, retrieval
from credence.plans import jobs
from credence.sources import testdata

K = 3


def q_label_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every review labelled real/fake from retrieval + facts + score."""
    lab = jobs.pseudo_labels(spark, sf, k=K)
    return lab.select("review_id", "pseudo_label", "fact_label", "fake_score")


def q_topk_similar_products(spark: SparkSession, sf: str) -> DataFrame:
    q = retrieval.embed_texts(jobs.context_records(spark, sf), "context", "qvec")
    r = retrieval.topk_similar(q, jobs.product_collection(spark, sf), k=K, vec_col="qvec", keep_dist=True)
    return retrieval.retrieval_rows(r, ["review_id"])


def q_topk_similar_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate top-k of every review by hyperplane signatures (recall: tests, README)."""
    q = retrieval.embed_texts(jobs.context_records(spark, sf), "context", "qvec")
    return lsh.topk_similar_lsh(q, jobs.product_collection(spark, sf), "review_id", k=K, vec_col="qvec")


def q_build_context(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.context_records(spark, sf).select("review_id", "product_id", "context")


def q_product_document(spark: SparkSession, sf: str) -> DataFrame:
    e = records.product_entries(testdata.products(spark, sf))
    return e.select("id", "document", *[F.col(f"metadata.{c}").alias(f"m_{c}") for c in
                                        ["product_name", "size", "price_usd", "value_price_usd", "sale_price_usd",
                                         "online_only", "highlights"]])


def q_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.label_counts(jobs.pseudo_labels(spark, sf, k=K))


QUERIES = {
    "label_reviews": q_label_reviews,
    "topk_similar_products": q_topk_similar_products,
    "topk_similar_lsh": q_topk_similar_lsh,
    "build_context": q_build_context,
    "product_document": q_product_document,
    "label_counts": q_label_counts,
}


# ---------------------------------------------------------------------------------------
# Shared bases
# ---------------------------------------------------------------------------------------
SEED = 7


def _qlabels(spark, sf):
    return testdata.quality_labels(spark, sf)


def _noisy_labels(spark, sf):
    """Quality labels with unknown / missing labels and a free-form ``tag`` label field."""
    q = _qlabels(spark, sf)
    p = F.col("pos")
    noisy = F.when(p % 9 == 0, F.lit(None).cast("string")).when(p % 9 == 1, F.lit("unknown")).otherwise(
        F.col("pseudo_label"))
    tag = (F.when(p % 5 == 0, F.lit("")).when(p % 5 == 1, F.lit(None).cast("string")).when(p % 5 == 2, F.lit("0"))
           .when(p % 5 == 3, F.lit("1")).otherwise(F.lit("real")))
    return q.withColumn("pseudo_label", noisy).withColumn("tag", tag)


def _own_pairs(spark, sf):
    """Each context record with its own product's collection entry (equi-join on id). The entries are
    shuffled: their columns are built from a few table columns, so the planner would underestimate them."""
    recs = jobs.context_records(spark, sf)
    ent = records.product_entries(testdata.products(spark, sf)).select(
        F.col("id").alias("product_id"), F.struct("id", "document", "metadata").alias("own"))
    return recs.join(ent.hint("merge"), "product_id", "left")


# ---------------------------------------------------------------------------------------
# Sampling / splits / metrics / windows
# ---------------------------------------------------------------------------------------
from credence.operators import metrics, sampling  # noqa: E402


def q_shuffle_rows(spark, sf):
    return sampling.shuffle_rows(_qlabels(spark, sf), SEED).select("review_id", "shuffle_rank")


def q_sample_exact_n(spark, sf):
    return sampling.sample_exact_n(_qlabels(spark, sf), 50, SEED).select("review_id", "pseudo_label", "sample_rank")


def q_balanced_dataset(spark, sf):
    out = sampling.balanced_dataset(_qlabels(spark, sf), 1.0, SEED)
    return out.select("review_id", "pseudo_label", "sample_rank")


def q_balanced_dataset_short(spark, sf):
    out = sampling.balanced_dataset(_qlabels(spark, sf), 10.0, SEED)
    return out.select("review_id", "pseudo_label", "sample_rank")


def q_stratified_split(spark, sf):
    out = sampling.balanced_dataset(_qlabels(spark, sf), 1.0, SEED, split=True, test_ratio=0.2)
    return out.select("review_id", "pseudo_label", "split")


def q_random_split(spark, sf):
    return sampling.random_split(_qlabels(spark, sf), 0.1, SEED).select("review_id", "split")


def q_pick_examples(spark, sf):
    return sampling.pick_examples(_qlabels(spark, sf), 2, 2, SEED).select(
        F.col("pos").cast("string").alias("review_id"), "pseudo_label", "context")


def q_filter_by_label(spark, sf):
    return _qlabels(spark, sf).where(F.col("pseudo_label") == "real").select("review_id", "pseudo_label")


def q_metrics_summary(spark, sf):
    return metrics.metrics_summary(_qlabels(spark, sf))


def q_classification_report(spark, sf):
    return metrics.classification_report(_qlabels(spark, sf))


def q_running_accuracy(spark, sf):
    return metrics.running_accuracy(_qlabels(spark, sf)).select("review_id", "running_accuracy")


def q_running_label_counts(spark, sf):
    return labeling.running_label_counts(_qlabels(spark, sf)).select(
        "review_id", "real_count", "fake_count", "total_count")


def q_distinct_labels(spark, sf):
    from credence.operators import dataset
    return metrics.distinct_labels(dataset.encode_labels_strict(_noisy_labels(spark, sf)))


def q_argmax_array(spark, sf):
    e = testdata.table(spark, sf, "embeddings")
    return e.select("vec_id", rules.argmax_array(F.col("embedding")).alias("argmax"))


def q_verdict_text(spark, sf):
    return _qlabels(spark, sf).select("review_id", rules.verdict_text(F.col("prediction")).alias("verdict"))


def q_flag_duplicates(spark, sf):
    rv = testdata.reviews(spark, sf).withColumn("pseudo_label", F.lit("real"))
    return labeling.flag_duplicates(rv, "review_text").select("review_id", "is_duplicate", "pseudo_label")


# ---------------------------------------------------------------------------------------
# Label handling
# ---------------------------------------------------------------------------------------
def q_split_real_fake(spark, sf):
    from credence.operators import dataset
    return dataset.split_real_fake(_noisy_labels(spark, sf), "tag").select("review_id", "side")


def q_encode_labels_strict(spark, sf):
    from credence.operators import dataset
    return dataset.encode_labels_strict(_noisy_labels(spark, sf)).select("review_id", "label")


def q_encode_labels_lenient(spark, sf):
    from credence.operators import dataset
    return dataset.encode_labels_lenient(_noisy_labels(spark, sf)).select("review_id", "label")


def q_explain_examples(spark, sf):
    from credence.operators import dataset
    ex = dataset.explain_examples(_noisy_labels(spark, sf))
    return ex.select("review_id", "label", "reason", "input_text", "target_text")


def q_parse_label(spark, sf):
    from credence.operators import dataset
    ex = dataset.explain_examples(_noisy_labels(spark, sf))
    return ex.select("review_id", rules.parse_label(F.col("target_text")).alias("from_target"),
                     rules.parse_label(F.col("context")).alias("from_context"))


def q_parse_explanation(spark, sf):
    from credence.operators import dataset
    ex = dataset.explain_examples(_noisy_labels(spark, sf))
    a = rules.parse_explanation(F.col("target_text"))
    b = rules.parse_explanation(F.col("context"))
    return ex.select("review_id", a["label"].alias("t_label"), a["reason"].alias("t_reason"),
                     b["label"].alias("c_label"), b["reason"].alias("c_reason"))


# ---------------------------------------------------------------------------------------
# Products and contexts
# ---------------------------------------------------------------------------------------
def q_product_summary(spark, sf):
    return records.product_summaries(testdata.products(spark, sf))


def q_product_metadata(spark, sf):
    e = records.product_entries(testdata.products(spark, sf))
    return e.select("id", "metadata.*")


def q_product_id_default(spark, sf):
    p = testdata.products(spark, sf)
    p = p.withColumn("product_id", F.when(F.col("pos") % 7 == 0, F.lit("")).otherwise(F.col("product_id")))
    return p.select("pos", ctxf.product_id_default().alias("id"))


def q_review_record(spark, sf):
    r = jobs.context_records(spark, sf)
    return r.select("review_id", "product_id", "pseudo_label", "meta.*")


def q_join_product_summary(spark, sf):
    j = records.join_product_summary(testdata.reviews(spark, sf), testdata.products(spark, sf))
    return j.select("review_id", "product_summary")


def q_reviews_with_known_product(spark, sf):
    return records.reviews_with_known_product(testdata.reviews(spark, sf), testdata.products(spark, sf)).select(
        "review_id")


def q_parse_context(spark, sf):
    r = jobs.context_records(spark, sf)
    return r.select("review_id", ctxf.parse_context(F.col("context")).alias("p")).select("review_id", "p.*")


def q_sort_products(spark, sf):
    return records.sort_products(testdata.products(spark, sf))


def q_build_request_context(spark, sf):
    return records.request_contexts(testdata.reviews(spark, sf), testdata.products(spark, sf)).select(
        "review_id", "context")


def q_retrieval_rank(spark, sf):
    q = retrieval.embed_texts(jobs.context_records(spark, sf), "context", "qvec")
    r = retrieval.topk_similar(q, jobs.product_collection(spark, sf), k=K, vec_col="qvec")
    x = r.select("review_id", F.posexplode("retrieved").alias("i", "doc"))
    return x.select("review_id", F.concat(F.lit("Rank "), (F.col("i") + 1).cast("string")).alias("rank_label"),
                    F.col("doc.id").alias("product_id"), F.col("doc.document").alias("document"),
                    F.substring("doc.document", 1, 400).alias("preview"))


# ---------------------------------------------------------------------------------------
# Scalar rules
# ---------------------------------------------------------------------------------------
def q_safe_casts(spark, sf):
    r = jobs.context_records(spark, sf)
    m = F.col("meta")
    return r.select("review_id", tx.safe_float(m["rating"]).alias("rating_f"),
                    tx.safe_int(m["is_recommended"]).alias("recommended_i"),
                    tx.safe_int(m["is_recommended"], strict=False).alias("recommended_loose"),
                    tx.safe_float(m["helpfulness"]).alias("helpfulness_f"),
                    tx.safe_int(m["total_feedback_count"]).alias("feedback_i"))


def q_text_norm(spark, sf):
    r = jobs.context_records(spark, sf)
    c = F.col("context")
    return r.select("review_id", F.length(tx.py_strip(c)).alias("stripped_len"), F.lower(c).alias("lower_ctx"),
                    F.length(tx.flatten_newlines(c)).alias("flat_len"), F.size(tx.split_words(c)).alias("n_words"))


def q_extract_capacity(spark, sf):
    r = jobs.context_records(spark, sf)
    x = r.select("review_id", F.posexplode(rules.extract_capacity(F.col("context"))).alias("i", "cap"))
    return x.select("review_id", "i", F.col("cap.amount").alias("amount"), F.col("cap.unit").alias("unit"),
                    rules.to_ml(F.col("cap.amount"), F.col("cap.unit")).alias("ml"))


def q_extract_price(spark, sf):
    r = jobs.context_records(spark, sf)
    return r.select("review_id", rules.extract_price(F.col("context")).alias("price"))


def _own_checks(spark, sf):
    o = _own_pairs(spark, sf)
    t = F.lower(F.col("context"))
    meta = F.col("own.metadata")
    return o, t, meta


def q_capacity_mismatch(spark, sf):
    o, t, meta = _own_checks(spark, sf)
    return o.select("review_id", F.coalesce(rules.capacity_mismatch(rules.capacities_ml(t), meta["size"]),
                                            F.lit(False)).alias("flag"))


def q_skin_type_mismatch(spark, sf):
    o, t, meta = _own_checks(spark, sf)
    return o.select("review_id", rules.skin_type_mismatch(t, meta["highlights"]).alias("flag"))


def q_gender_mismatch(spark, sf):
    o, t, meta = _own_checks(spark, sf)
    return o.select("review_id", rules.gender_mismatch(t, meta["highlights"]).alias("flag"))


def q_online_only_mismatch(spark, sf):
    o, t, meta = _own_checks(spark, sf)
    return o.select("review_id", F.coalesce(rules.online_only_mismatch(t, meta["online_only"]),
                                            F.lit(False)).alias("flag"))


def q_price_mismatch(spark, sf):
    o, t, meta = _own_checks(spark, sf)
    flag = rules.price_mismatch(rules.extract_price(t), meta["price_usd"], meta["value_price_usd"],
                                meta["sale_price_usd"])
    return o.select("review_id", F.coalesce(flag, F.lit(False)).alias("flag"))


def q_factual_label(spark, sf):
    o = _own_pairs(spark, sf)
    own = F.when(F.col("own").isNotNull(), F.array(F.col("own"))).otherwise(F.array().cast(
        "array<struct<id:string,document:string,metadata:struct<product_id:string,product_name:string,"
        "brand_id:string,brand_name:string,rating:string,reviews:string,size:string,price_usd:string,"
        "value_price_usd:string,sale_price_usd:string,online_only:string,highlights:string>>>"))
    return rules.with_factual_label(o.withColumn("own_arr", own), "fact_label", retrieved="own_arr").select(
        "review_id", "fact_label")


def q_fake_score(spark, sf):
    r = jobs.context_records(spark, sf)
    r = rules.with_fake_score(r, "score_nan", missing="nan")
    r = rules.with_fake_score(r, "score_null", missing="null")
    r = rules.with_fake_score(r, "score_loose", missing="nan", strict_int=False)
    return r.select("review_id", "score_nan", "score_null", "score_loose")


def q_final_label(spark, sf):
    o = q_factual_label(spark, sf)
    # Shuffled: a row for every review would pass the driver under a large broadcast threshold.
    r = jobs.context_records(spark, sf).join(o.hint("merge"), "review_id", "inner")
    r = rules.with_fake_score(rules.with_fake_score(r, "s_nan", missing="nan"), "s_null", missing="null")
    return r.select("review_id", rules.final_label(F.col("fact_label"), F.col("s_nan"), F.col("context"),
                                                   F.col("meta")).alias("label_nan"),
                    rules.final_label(F.col("fact_label"), F.col("s_null"), F.col("context"), F.col("meta"),
                                      "null").alias("label_null"))


def q_format_valid(spark, sf):
    r = jobs.context_records(spark, sf)
    return r.select("review_id", rules.format_valid(F.col("context")).alias("valid"))


def q_row_count(spark, sf):
    return jobs.context_records(spark, sf).agg(F.count(F.lit(1)).alias("n"))


def q_embed_texts(spark, sf):
    e = retrieval.embed_texts(jobs.context_records(spark, sf), "context", "vec")
    x = e.select("review_id", F.posexplode("vec").alias("i", "v"))
    return x.select("review_id", "i", F.col("v").cast("double").alias("v"))


QUERIES.update({
    "shuffle_rows": q_shuffle_rows,
    "sample_exact_n": q_sample_exact_n,
    "balanced_dataset": q_balanced_dataset,
    "balanced_dataset_short": q_balanced_dataset_short,
    "stratified_split": q_stratified_split,
    "random_split": q_random_split,
    "pick_examples": q_pick_examples,
    "filter_by_label": q_filter_by_label,
    "metrics_summary": q_metrics_summary,
    "classification_report": q_classification_report,
    "running_accuracy": q_running_accuracy,
    "running_label_counts": q_running_label_counts,
    "distinct_labels": q_distinct_labels,
    "argmax_array": q_argmax_array,
    "verdict_text": q_verdict_text,
    "flag_duplicates": q_flag_duplicates,
    "split_real_fake": q_split_real_fake,
    "encode_labels_strict": q_encode_labels_strict,
    "encode_labels_lenient": q_encode_labels_lenient,
    "explain_examples": q_explain_examples,
    "parse_label": q_parse_label,
    "parse_explanation": q_parse_explanation,
    "product_summary": q_product_summary,
    "product_metadata": q_product_metadata,
    "product_id_default": q_product_id_default,
    "review_record": q_review_record,
    "join_product_summary": q_join_product_summary,
    "reviews_with_known_product": q_reviews_with_known_product,
    "parse_context": q_parse_context,
    "sort_products": q_sort_products,
    "build_request_context": q_build_request_context,
    "retrieval_rank": q_retrieval_rank,
    "safe_casts": q_safe_casts,
    "text_norm": q_text_norm,
    "extract_capacity": q_extract_capacity,
    "extract_price": q_extract_price,
    "capacity_mismatch": q_capacity_mismatch,
    "skin_type_mismatch": q_skin_type_mismatch,
    "gender_mismatch": q_gender_mismatch,
    "online_only_mismatch": q_online_only_mismatch,
    "price_mismatch": q_price_mismatch,
    "factual_label": q_factual_label,
    "fake_score": q_fake_score,
    "final_label": q_final_label,
    "format_valid": q_format_valid,
    "row_count": q_row_count,
    "embed_texts": q_embed_texts,
})


# ---------------------------------------------------------------------------------------
# Augmentation
# ---------------------------------------------------------------------------------------
from credence.operators import augment, dataset  # noqa: E402


def q_pair_real_fake(spark, sf):
    p = augment.pair_real_fake(_qlabels(spark, sf), ratio=1.0, seed=SEED)
    return p.select("step", "review_id", "fake_context")


def q_random_review_info(spark, sf):
    d = testdata.table(spark, sf, "documents")
    return d.select("doc_id", augment.random_review_info(SEED, F.col("doc_id")).alias("i")).select("doc_id", "i.*")


def q_augment_text(spark, sf):
    q = _qlabels(spark, sf)
    return q.select("review_id", augment.augment_text(F.col("context"), SEED, F.col("review_id")).alias("augmented"))


def q_inflate_duplicates(spark, sf):
    d = testdata.table(spark, sf, "documents").select(F.col("doc_id").alias("step"))
    n = tx.seeded_int(SEED, F.col("step"), augment.TROLL_MAX_COPIES + 1, "troll:").cast("int")
    x = d.where(F.col("step") % augment.TROLL_EVERY == 0).select(
        "step", F.posexplode(F.array_repeat(F.lit(1), n)).alias("copy", "one"))
    return x.select("step", (F.col("copy") + 1).alias("copy"))


def q_build_prompt(spark, sf):
    o = _own_pairs(spark, sf).where(F.col("own").isNotNull())
    return o.select("review_id", augment.build_prompt(F.col("context"), F.col("own.document"),
                                                      F.col("own.metadata")).alias("prompt"))


def q_field_fallback(spark, sf):
    o = _own_pairs(spark, sf).where(F.col("own").isNotNull())
    p = F.col("pos")
    top = F.when(p % 3 == 0, F.lit(None).cast("string")).when(p % 3 == 1, F.lit("")).otherwise(
        F.concat(F.lit("Top "), p.cast("string")))
    meta_name = F.when(p % 4 == 0, F.lit("")).otherwise(F.col("own.metadata.product_name"))
    rec = o.select("review_id", top.alias("product_name"),
                   F.struct(meta_name.alias("product_name"), F.col("meta.rating").alias("rating")).alias("meta"))
    return rec.select("review_id", dataset.field_fallback(rec, "product_name").alias("name_or_null"),
                      dataset.product_name_or_default(rec).alias("product_name"),
                      dataset.field_fallback(rec, "rating", "n/a").alias("rating"))


def q_product_name_fallback(spark, sf):
    return q_field_fallback(spark, sf).select("review_id", "product_name")


def q_synth_fakes(spark, sf):
    out = augment.synth_fakes(_qlabels(spark, sf).withColumn("meta", F.struct(*[
        F.lit(None).cast("string").alias(f) for f in augment.META_FIELDS])),
        jobs.product_collection(spark, sf), ratio=1.0, seed=SEED, combine_ratio=2, troll=True)
    return out.select("pos", "step", "kind", "copy", "review_id", "context", "pseudo_label", "rating", "is_recommended",
                      "total_feedback_count", "total_pos_feedback_count", "total_neg_feedback_count", "helpfulness",
                      "review_title", F.col("meta.product_name").alias("meta_product_name"))


def q_augment_union(spark, sf):
    base = _qlabels(spark, sf).withColumn("meta", F.struct(*[
        F.lit(None).cast("string").alias(f) for f in augment.META_FIELDS]))
    syn = augment.synth_fakes(base, jobs.product_collection(spark, sf), ratio=0.5, seed=SEED)
    return augment.augment_union(base, syn, SEED).select("row_key", "pseudo_label", "shuffle_rank")


QUERIES.update({
    "pair_real_fake": q_pair_real_fake,
    "random_review_info": q_random_review_info,
    "augment_text": q_augment_text,
    "inflate_duplicates": q_inflate_duplicates,
    "build_prompt": q_build_prompt,
    "field_fallback": q_field_fallback,
    "product_name_fallback": q_product_name_fallback,
    "synth_fakes": q_synth_fakes,
    "augment_union": q_augment_union,
})


# ---------------------------------------------------------------------------------------
# Models and explanations
# ---------------------------------------------------------------------------------------
from credence.operators import collection, models, token_model  # noqa: E402


def q_explain_reviews(spark, sf):
    flags = models.rule_flags(_own_pairs(spark, sf))
    ex = models.explain_reviews(flags)
    return ex.select("review_id", "pseudo_label", "reason", "explanation", "rules_fired",
                     rules.parse_label(F.col("explanation")).alias("parsed_label"))


def q_evaluate_explainer(spark, sf):
    ex = models.explain_reviews(models.rule_flags(_own_pairs(spark, sf))).select("pos", "explanation")
    truth = testdata.table(spark, sf, "labels").select(
        F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, "real").otherwise("fake").alias("pseudo_label"))
    # Shuffled: a labels file of a few MB may hold a million rows, too many for the driver.
    return models.evaluate_explainer(ex.join(truth.hint("merge"), "pos"))


def q_predict_requests(spark, sf):
    model, _ = models.train_classifier(_classifier_examples(spark, sf), test_fraction=0.2, seed=SEED)
    requests = records.request_contexts(testdata.reviews(spark, sf), testdata.products(spark, sf))
    return models.predict_requests(model, requests).select("review_id", "prediction", "verdict")


def _classifier_examples(spark, sf):
    return dataset.encode_labels_strict(_qlabels(spark, sf))


def q_train_classifier(spark, sf):
    _, summary = models.train_classifier(_classifier_examples(spark, sf), test_fraction=0.2, seed=SEED)
    return summary


def q_evaluate_classifier(spark, sf):
    model, _ = models.train_classifier(_classifier_examples(spark, sf), test_fraction=0.2, seed=SEED)
    held_out = sampling.random_split(_qlabels(spark, sf), 0.2, SEED).filter("split = 'test'").drop("split")
    return models.evaluate_classifier(model, held_out)


# ---------------------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------------------
import uuid  # noqa: E402

from credence.schemas import CONTEXT_RECORD_SCHEMA  # noqa: E402
from credence.session import checkpoint_dir  # noqa: E402
from credence.sources import files  # noqa: E402
from pyspark.sql.types import LongType, StructField, StructType  # noqa: E402


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/credence-io/{name}-{uuid.uuid4().hex}"


def _write_ordered_csv(df, path, parts=None):
    """CSV part files in position order (range partitions, sorted inside), no pos column."""
    n = parts or df.sparkSession.sparkContext.defaultParallelism
    ordered = df.repartitionByRange(n, "pos").sortWithinPartitions("pos").drop("pos")
    files.write_csv(ordered, path)


def q_scan_reviews_csv(spark, sf):
    path = _scratch(spark, "reviews_csv")
    _write_ordered_csv(testdata.reviews(spark, sf), path)
    r = files.read_reviews_csv(spark, path)
    return r.select("review_id", "product_id", "rating", "is_recommended", "helpfulness", "review_title",
                    "review_text")


def q_scan_products_csv(spark, sf):
    path = _scratch(spark, "products_csv")
    _write_ordered_csv(testdata.products(spark, sf), path)
    p = files.read_products_csv(spark, path)
    return p.select("product_id", "product_name", "size", "value_price_usd", "online_only", "highlights")


def _records_jsonl(spark, sf):
    path = _scratch(spark, "records_jsonl")
    files.write_jsonl(jobs.context_records(spark, sf), path)
    schema = StructType(CONTEXT_RECORD_SCHEMA.fields + [StructField("pos", LongType(), True)])
    return path, schema


def q_roundtrip_jsonl(spark, sf):
    path, schema = _records_jsonl(spark, sf)
    back = files.read_jsonl(spark, path, schema)
    return back.select("review_id", "product_id", "context", "pseudo_label", "meta.*")


def q_scan_jsonl(spark, sf):
    path, schema = _records_jsonl(spark, sf)
    back = files.read_jsonl(spark, path, schema)
    return back.select("review_id", "context")


def q_limit_prefix(spark, sf):
    return files.limit_prefix(jobs.context_records(spark, sf), 100).select("review_id", "context")


def q_json_roundtrip(spark, sf):
    r = jobs.context_records(spark, sf)
    js = F.to_json(F.col("meta"), {"ignoreNullFields": "false"})
    back = F.from_json(js, r.schema["meta"].dataType)
    return r.select("review_id", js.alias("meta_json"), (back == F.col("meta")).alias("same"))


def q_upsert_products(spark, sf):
    """Half of the products stored, then all offered with repeated ids, then once more: the re-opened collection."""
    path = _scratch(spark, "collection")
    products = testdata.products(spark, sf)
    collection.append(spark, path, records.build_collection(products.where(F.col("pos") % 2 == 0)))
    batch = records.build_collection(products.unionByName(products.where(F.col("pos") % 5 == 0)))
    collection.append(spark, path, batch)
    collection.append(spark, path, batch)
    stored = collection.open_collection(spark, path)
    return stored.select("id", "document", F.size("embedding").alias("dim"))


def q_duplicate_split_files(spark, sf):
    """The flagged reviews written in two partitions, twice, and both outputs read back."""
    rv = testdata.reviews(spark, sf).withColumn("pseudo_label", F.lit("real"))
    path = _scratch(spark, "duplicates")
    flagged = labeling.flag_duplicates(rv, "review_text").select("review_id", "pseudo_label", "is_duplicate")
    for _ in range(2):
        labeling.write_duplicate_split(flagged, path)
    kept, duplicates = labeling.read_duplicate_split(spark, path)
    return kept.withColumn("file", F.lit("cleaned")).unionByName(duplicates.withColumn("file", F.lit("duplicates")))


def q_model_roundtrip(spark, sf):
    """The trained classifier saved and loaded: equal predictions for every example."""
    examples = _classifier_examples(spark, sf)
    model, _ = models.train_classifier(examples, test_fraction=0.2, seed=SEED)
    path = _scratch(spark, "model")
    models.save_model(model, path)
    again = models.predict(models.load_model(path), examples.select("review_id", "text")).select("review_id", F.col("prediction").alias("loaded"))
    first = models.predict(model, examples.select("review_id", "text")).select("review_id", "prediction")
    return first.join(again, "review_id").select("review_id", (F.col("prediction") == F.col("loaded")).alias("same"))


def _token_model(spark, sf):
    """Token weights of the training part, written and read back; the held-out part."""
    split = sampling.random_split(_classifier_examples(spark, sf), 0.2, SEED)
    weights = token_model.fit(split.filter("split = 'train'"))
    path = _scratch(spark, "token-model")
    weights.write.parquet(path)
    return spark.read.parquet(path), split.filter("split = 'test'")


def q_token_model(spark, sf):
    return _token_model(spark, sf)[0]


def q_evaluate_token_model(spark, sf):
    weights, held_out = _token_model(spark, sf)
    found = token_model.predict(weights, held_out).select("pos", "prediction")
    return metrics.classification_report(held_out.select("pos", "label").join(found, "pos"))


def q_predict_token_model(spark, sf):
    weights, _ = _token_model(spark, sf)
    requests = records.request_contexts(testdata.reviews(spark, sf), testdata.products(spark, sf))
    found = token_model.predict(weights, requests, "review_id", "context")
    return found.select("review_id", F.round("score", 4).alias("score"), "prediction", rules.verdict_text(F.col("prediction")).alias("verdict"))


QUERIES.update({
    "explain_reviews": q_explain_reviews,
    "train_classifier": q_train_classifier,
    "evaluate_explainer": q_evaluate_explainer,
    "predict_requests": q_predict_requests,
    "evaluate_classifier": q_evaluate_classifier,
    "scan_reviews_csv": q_scan_reviews_csv,
    "scan_products_csv": q_scan_products_csv,
    "roundtrip_jsonl": q_roundtrip_jsonl,
    "scan_jsonl": q_scan_jsonl,
    "limit_prefix": q_limit_prefix,
    "json_roundtrip": q_json_roundtrip,
    "upsert_products": q_upsert_products,
    "duplicate_split_files": q_duplicate_split_files,
    "model_roundtrip": q_model_roundtrip,
    "token_model": q_token_model,
    "evaluate_token_model": q_evaluate_token_model,
    "predict_token_model": q_predict_token_model,
})


# ---------------------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------------------
from credence.streaming import scoring  # noqa: E402


def q_stream_label_reviews(spark, sf):
    """The labelling job as a stream over review CSV files; returns what the sink holds."""
    src = _scratch(spark, "stream_in")
    _write_ordered_csv(testdata.reviews(spark, sf), src)
    header = testdata.reviews(spark, sf).drop("pos").columns
    stream = scoring.read_review_stream(spark, src, header, max_files_per_trigger=2)
    products, collection = testdata.products(spark, sf), retrieval.pack_collection(jobs.product_collection(spark, sf))

    def labelled(batch):
        found = scoring.label_review_stream(batch, products, collection)
        return found.select("review_id", "pseudo_label", "fact_label", "fake_score")

    out = _scratch(spark, "stream_out")
    q = scoring.start_file_sink(stream, out, _scratch(spark, "stream_ckpt"), each=labelled)
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


#: Rows of an arriving file (some 5 KB each on the test tables).
ARRIVING_FILE_ROWS = 20_000


def q_stream_flag_duplicates(spark, sf):
    """Reviews arriving in three parts, each a micro-batch of two files or more; the first copy has the smallest
    id. A file is read by one task, so a part has as many files as its rows need."""
    src, out, ckpt = _scratch(spark, "dup_in"), _scratch(spark, "dup_out"), _scratch(spark, "dup_ckpt")
    reviews = testdata.reviews(spark, sf)
    last, rows = reviews.agg(F.max("pos"), F.count(F.lit(1))).first()
    third, parts = last // 3 + 1, max(2, -(-rows // (3 * ARRIVING_FILE_ROWS)))
    for i in range(3):
        _write_ordered_csv(reviews.where(F.floor(F.col("pos") / third) == i), f"{src}/part{i}", parts=parts)
        stream = scoring.read_review_stream(spark, f"{src}/*", reviews.drop("pos").columns, max_files_per_trigger=parts)
        q = scoring.start_duplicate_flags(stream, out, ckpt, "review_text", "review_id", "review_id")
        q.awaitTermination()
    res = spark.read.parquet(f"{out}/flags")
    return res.select(F.col("row_key").alias("review_id"), "is_duplicate",
                      F.when(F.col("is_duplicate"), F.lit("fake")).otherwise(F.lit("real")).alias("pseudo_label"))


QUERIES.update({
    "stream_label_reviews": q_stream_label_reviews,
    "stream_flag_duplicates": q_stream_flag_duplicates,
})


def q_distinct_texts(spark, sf):
    return labeling.distinct_by_text(testdata.reviews(spark, sf), "review_text").select("review_id")


QUERIES.update({"distinct_texts": q_distinct_texts})


# ---------------------------------------------------------------------------------------
# Plug-in models: the batch interfaces of a language model and of a sentence encoder
# ---------------------------------------------------------------------------------------
#: One line in the generated format; first hex digits that give no answer, or a malformed one.
STUB_ANSWER = "Review title: try {attempt} | Review text: {text} | Rating: 1 | Product summary: p by b. Highlights: h."
STUB_SILENT, STUB_MALFORMED = "012", "345"
STUB_DIM = 4


def load_stub_model():
    """A seeded stand-in for a language model: some prompts get no answer, some a malformed one."""
    import hashlib

    def answer(prompt: str, attempt: int) -> str | None:
        code = hashlib.md5(f"{attempt}:{prompt}".encode()).hexdigest()
        if code[0] in STUB_SILENT:
            return None
        return "not in the format" if code[0] in STUB_MALFORMED else STUB_ANSWER.format(attempt=attempt, text=code[:8])

    return lambda prompts, attempt: [answer(p, attempt) for p in prompts]


def load_stub_encoder():
    """Text shape as a vector: code points, letters e, spaces, ASCII digits."""
    return lambda texts: [[len(t), t.count("e"), t.count(" "), sum(c in "0123456789" for c in t)] for t in texts]


def q_generate_plugin(spark, sf):
    """A plugged-in generator asked up to three times for every review with a known product."""
    own = _own_pairs(spark, sf).where(F.col("own").isNotNull()).select("review_id", "context", "own")
    cols = {"real": F.col("context"), "fake": F.col("own.document"), "meta": F.col("own.metadata")}
    model = augment.batch_generator(load=load_stub_model, batch_size=32)
    return augment.generate_with_retry(own, cols, model, "generated").select("review_id", "generated")


def q_retrieve_plugin(spark, sf):
    """Exact top-k of every review among all products, both embedded by a plugged-in encoder."""
    encoder = retrieval.batch_embedder(dim=STUB_DIM, batch_size=64, load=load_stub_encoder)
    q = retrieval.embed_texts(jobs.context_records(spark, sf), "context", "qvec", embedder=encoder)
    coll = jobs.product_collection(spark, sf, dim=STUB_DIM, embedder=encoder)
    return retrieval.retrieval_rows(retrieval.topk_similar(q, coll, k=K, vec_col="qvec", keep_dist=True), ["review_id"])


QUERIES.update({"generate_plugin": q_generate_plugin, "retrieve_plugin": q_retrieve_plugin})
