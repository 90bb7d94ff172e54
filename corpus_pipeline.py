"""Documents to packed training sequences in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``. Null, empty and repeated rows follow the operators' docstrings;
columns beyond those of ``documents`` pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import exact_dedup, mixing, ngram_join, packing, quality
from credence.llm._scratch import materialize

NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Co-trained on ``labels``: documents judged low quality or toxic go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingle sets with Jaccard >= 0.8 the smallest doc_id stays.
    Rows with a null id stay."""
    groups = ngram_join.similar_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    dropped = materialize(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "near-copies")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight asks."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained classifier, which SQL cannot express; tests compare each stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
