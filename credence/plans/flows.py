"""File-in / file-out jobs: the whole workflow as Spark jobs.

1. ``prepare_contexts``   review CSVs (+ product CSV) -> context records (JSONL)
2. ``build_product_collection`` product CSV -> product collection (parquet, upsert)
3. ``pseudo_label``       context records + collection -> labelled records (JSONL)
                          (optionally ``<out>_cleaned`` / ``<out>_duplicates``)
4. ``small_dataset``      labelled records -> balanced set (+ ``_train`` / ``_test``)
5. ``synthesize``         labelled records + collection -> synthetic fakes, augmented set
6. ``train`` / ``evaluate`` examples -> Spark ML model; model + test file -> report

Each step reads what the previous one wrote, so a failed step restarts from files in
the shared storage instead of replaying the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credence.operators import augment, collection, labeling, models, records, sampling
from credence.schemas import CONTEXT_RECORD_SCHEMA, LABELLED_RECORD_SCHEMA
from credence.session import checkpoint_dir
from credence.sources import files


def _records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSONL records with their position: the stored one, else the file order."""
    return files.read_jsonl(spark, path, schema, pos_col="pos")


def prepare_contexts(spark: SparkSession, input_dir: str, products_csv: str | None, out_path: str,
                     max_rows: int | None = None) -> int:
    """Context records of every review CSV (file order), joined to product summaries."""
    reviews = files.read_reviews_csv(spark, input_dir)
    products = files.read_products_csv(spark, products_csv) if products_csv else None
    recs = records.review_records(reviews, products)
    if max_rows is not None:
        recs = files.limit_prefix(recs, max_rows)
    files.write_jsonl(recs, out_path)
    return _records(spark, out_path, CONTEXT_RECORD_SCHEMA).count()


def build_product_collection(spark: SparkSession, products_csv: str, collection_path: str, dim: int = 64,
                             embedder=None) -> int:
    """Embed product documents and add entries whose id is not stored yet."""
    products = files.read_products_csv(spark, products_csv)
    if products is None:
        raise FileNotFoundError(products_csv)
    new = records.build_collection(products, dim=dim, embedder=embedder)
    collection.append(spark, collection_path, new)
    return collection.open_collection(spark, collection_path).count()


def pseudo_label(spark: SparkSession, in_path: str, collection_path: str, out_path: str, top_k: int = 3,
                 dedup: bool = False, **label_kw) -> DataFrame:
    """Label every context record; writes JSONL and returns the label counts."""
    recs = _records(spark, in_path, CONTEXT_RECORD_SCHEMA)
    coll = collection.open_collection(spark, collection_path)
    out = labeling.label_reviews(recs, coll, k=top_k, keep_scores=False, **label_kw)
    files.write_jsonl(out, out_path)
    written = _records(spark, out_path, LABELLED_RECORD_SCHEMA)
    if dedup:
        flagged = labeling.flag_duplicates(written)
        cleaned, dups = labeling.split_duplicates(flagged)
        base = out_path[:-6] if out_path.endswith(".jsonl") else out_path
        files.write_jsonl(cleaned, f"{base}_cleaned.jsonl")
        files.write_jsonl(dups, f"{base}_duplicates.jsonl")
    return labeling.label_counts(written)


def small_dataset(spark: SparkSession, in_path: str, out_path: str, ratio_real_to_fake: float = 1.0,
                  split: bool = False, test_ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """Balanced (and optionally split) dataset; writes the combined set and, with ``split``,
    ``<stem>_train.jsonl`` / ``<stem>_test.jsonl``, each in a seeded shuffled order."""
    recs = _records(spark, in_path, LABELLED_RECORD_SCHEMA)
    ds = sampling.balanced_dataset(recs, ratio_real_to_fake, seed, split=split, test_ratio=test_ratio)
    # Three outputs come from one sample: materialise it once in the shared checkpoint folder.
    checkpoint_dir(spark)
    ds = ds.checkpoint(eager=True)
    cols = [c for c in recs.columns]
    shuffled = sampling.shuffle_rows(ds, seed)
    files.write_jsonl(shuffled.orderBy("shuffle_rank").select(*cols), out_path)
    if split:
        train_path, test_path = files.derived_paths(out_path)
        for name, path in (("train", train_path), ("test", test_path)):
            part = sampling.shuffle_rows(ds.where(F.col("split") == name), seed)
            files.write_jsonl(part.orderBy("shuffle_rank").select(*cols), path)
    return ds.groupBy("pseudo_label", *(["split"] if split else [])).count()


def synthesize(spark: SparkSession, in_path: str, collection_path: str, out_fake_path: str, out_train_path: str,
               ratio: float = 1.0, combine_ratio: int = 0, troll: bool = False, seed: int = 0,
               generator=augment.template_generator) -> int:
    """Synthetic fakes written to ``out_fake_path``; originals + fakes in a seeded order to
    ``out_train_path``. With no steps to generate, the originals are written and an error raised."""
    recs = _records(spark, in_path, LABELLED_RECORD_SCHEMA)
    n_real = recs.where(F.col("pseudo_label") == "real").count()
    if int(ratio * n_real) <= 0:
        files.write_jsonl(recs, out_train_path)
        raise ValueError(f"no synthetic samples to generate ({int(ratio * n_real)})")
    coll = collection.open_collection(spark, collection_path)
    fakes = augment.synth_fakes(recs, coll, ratio=ratio, seed=seed, combine_ratio=combine_ratio, troll=troll,
                                generator=generator)
    files.write_jsonl(fakes, out_fake_path)
    both = augment.augment_union(recs.drop("retrieved"), spark.read.json(out_fake_path, schema=fakes.schema), seed)
    files.write_jsonl(both.orderBy("shuffle_rank").drop("shuffle_rank", "row_key"), out_train_path)
    return spark.read.json(out_fake_path, schema=fakes.schema).count()


def train(spark: SparkSession, train_path: str, model_dir: str, test_fraction: float = 0.1, seed: int = 0,
          max_rows: int | None = None) -> DataFrame:
    """Fit the classifier on strict-encoded examples; saves the model; returns held-out metrics."""
    from credence.operators import dataset

    recs = _records(spark, train_path, CONTEXT_RECORD_SCHEMA)
    if max_rows:
        recs = files.limit_prefix(recs, max_rows)
    model, summary = models.train_classifier(dataset.encode_labels_strict(recs), test_fraction, seed)
    models.save_model(model, model_dir)
    return summary


def predict(spark: SparkSession, model_dir: str, requests_csv: str, products_csv: str, out_path: str) -> int:
    """Verdicts for a table of requests (review CSV columns), written as JSONL."""
    requests = records.request_contexts(files.read_csv_table(spark, requests_csv, "*.csv"), files.read_products_csv(spark, products_csv))
    files.write_jsonl(models.predict_requests(models.load_model(model_dir), requests), out_path)
    return spark.read.json(out_path).count()


def evaluate(spark: SparkSession, model_dir: str, test_path: str, max_rows: int | None = None) -> DataFrame:
    recs = _records(spark, test_path, CONTEXT_RECORD_SCHEMA)
    return models.evaluate_classifier(models.load_model(model_dir), recs, max_rows=max_rows)
