"""Label handling for training / evaluation sets (row-wise, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from credence.functions import rules

# Label encodings. Training/evaluation: fake=0, real=1. Augmentation input: 0=real, 1=fake.
TRAIN_CODES = {"fake": 0, "real": 1}
SPLIT_REAL = ("real", "0")
SPLIT_FAKE = ("fake", "1")
PRODUCT_NAME_FALLBACK = "a skincare product"


def _truthy(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        return c.isNotNull() & (c != 0)
    return c.isNotNull() & (c.cast("string") != "")


def normalised_label(df: DataFrame, label_field: str = "pseudo_label") -> Column:
    """``rec[label_field] or rec['pseudo_label'] or rec['label']`` as text: falsy values
    (NULL, empty, numeric 0) fall through; the last field is taken as it is."""
    fields = [f for f in [label_field, "pseudo_label", "label"] if f in df.columns]
    if not fields:
        return F.lit(None).cast("string")
    out = F.col(fields[-1]).cast("string")
    for f in reversed(fields[:-1]):
        out = F.when(_truthy(df, f), F.col(f).cast("string")).otherwise(out)
    return out


def split_real_fake(df: DataFrame, label_field: str = "pseudo_label") -> DataFrame:
    """Adds ``side`` = real / fake / NULL (neither)."""
    v = normalised_label(df, label_field)
    side = F.when(v.isin(*SPLIT_REAL), F.lit("real")).when(v.isin(*SPLIT_FAKE), F.lit("fake"))
    return df.withColumn("side", side)


def field_fallback(df: DataFrame, key: str, default=None) -> Column:
    """Top-level ``key`` unless NULL/empty, else ``meta.key`` unless NULL/empty, else default."""
    cands = []
    if key in df.columns:
        cands.append(F.col(key).cast("string"))
    if "meta" in df.columns and key in [f.name for f in df.schema["meta"].dataType.fields]:
        cands.append(F.col(f"meta.{key}").cast("string"))
    cands = [F.when(c != "", c) for c in cands]
    if default is not None:
        cands.append(F.lit(default))
    return F.coalesce(*cands) if cands else F.lit(None).cast("string")


def product_name_or_default(df: DataFrame, fallback: str = PRODUCT_NAME_FALLBACK) -> Column:
    return field_fallback(df, "product_name", fallback)


def encode_labels_strict(df: DataFrame, label_col: str = "pseudo_label", text_col: str = "context") -> DataFrame:
    """Classifier examples: unknown labels dropped; fake=0, real=1. Output keeps other columns
    and sets ``text``, ``label``."""
    lab = F.col(label_col)
    return (df.where(lab.isin("fake", "real"))
            .withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
            .withColumn("label", F.when(lab == "fake", TRAIN_CODES["fake"]).otherwise(TRAIN_CODES["real"]).cast("int")))


def encode_labels_lenient(df: DataFrame, label_col: str = "pseudo_label", text_col: str = "context") -> DataFrame:
    """Evaluation examples: every row kept; anything but ``fake`` is real (1)."""
    lab = F.col(label_col)
    return (df.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
            .withColumn("label", F.when(F.coalesce(lab == "fake", F.lit(False)), TRAIN_CODES["fake"])
                        .otherwise(TRAIN_CODES["real"]).cast("int")))


def explain_examples(df: DataFrame, label_col: str = "pseudo_label", context_col: str = "context") -> DataFrame:
    """Explainer examples for valid labels: ``label``, ``reason`` (template per label),
    ``input_text`` (prompt) and ``target_text``."""
    lab = F.col(label_col)
    out = df.where(lab.isin("fake", "real")).withColumn("label", lab).withColumn("reason", rules.reason_for(lab))
    return (out.withColumn("input_text", rules.explainer_prompt(F.col(context_col)))
            .withColumn("target_text", rules.explainer_target(F.col("label"), F.col("reason"))))


def label_totals(df: DataFrame) -> DataFrame:
    """real/fake example counts of an encoded set (label 1/0)."""
    return df.agg(F.count_if(F.col("label") == TRAIN_CODES["real"]).alias("real_count"),
                  F.count_if(F.col("label") == TRAIN_CODES["fake"]).alias("fake_count"))
