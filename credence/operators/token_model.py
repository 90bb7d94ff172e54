"""A text classifier whose fitted model is a table of token weights.

Multinomial naive Bayes over lower-cased ``[a-z0-9]+`` tokens: a token's weight is the difference of
its smoothed log rates in the two classes. Fitting is one aggregate over (token, label), scoring a
join with the weight table and a sum per text, so the model is a DataFrame like any other: it can be
written, read back, joined and stated in SQL. Nothing is collected.

A token's occurrences in one text are counted before the join, and texts meet the weights by token;
the weight table is repeated over salts (``skew.spread_lookup``), so a very common token is met by
several tasks. Texts without a known token have the prior's score. Scores at or over 0 predict 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.operators.skew import spread_lookup

#: The weight table's row of the prior and of tokens that were never seen.
PRIOR = ""
#: Rows whose words are counted at once.
COUNTED_ROWS = 256


def tokens(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """``key_col, token, n``: occurrences per text, counted inside the row's own array (no shuffle)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    key_type = df.schema[key_col].dataType.simpleString()
    return df.select(F.col(key_col).alias("key"), words.alias("words")).mapInArrow(
        _counted, f"key {key_type}, token string, n bigint").select(F.col("key").alias(key_col), "token", "n")


def _counted(batches):
    """One row per (row, distinct token), a few rows' words at a time."""
    for rb in batches:
        for s in range(0, rb.num_rows, COUNTED_ROWS):
            keys, words = (c.slice(s, COUNTED_ROWS) for c in rb.columns)
            coded = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            pair, n = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, code = np.divmod(pair, max(1, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), coded.dictionary.take(pa.array(code)), pa.array(n)], names=["key", "token", "n"])


def fit(examples: DataFrame, key_col: str = "pos", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """``token, weight`` from texts labelled 0 and 1: the log of (n1 + 1) / (N1 + V) over (n0 + 1) / (N0 + V),
    with V distinct tokens; the row of ``PRIOR`` holds log((texts of 1 + 1) / (texts of 0 + 1))."""
    label = F.col(label_col)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    counts = examples.filter(label.isin(0, 1)).select(F.explode(words).alias("token"), label.alias("y")).groupBy("token").agg(
        F.sum(F.col("y").cast("long")).alias("n1"), F.sum(1 - F.col("y").cast("long")).alias("n0"))
    totals = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count(F.lit(1)).alias("v"))  # one row
    rate = lambda n, t: (F.col(n) + 1) / (F.col(t) + F.col("v"))
    weights = counts.join(F.broadcast(totals)).select("token", F.log(rate("n1", "t1") / rate("n0", "t0")).alias("weight"))
    prior = examples.agg(F.log((F.count(F.when(label == 1, 1)) + 1) / (F.count(F.when(label == 0, 1)) + 1)).alias("weight"))
    return weights.unionByName(prior.select(F.lit(PRIOR).alias("token"), "weight"))


def predict(weights: DataFrame, df: DataFrame, key_col: str = "pos", text_col: str = "text") -> DataFrame:
    """``key_col, score, prediction`` of every row (``key_col`` unique)."""
    found = spread_lookup(tokens(df, key_col, text_col), weights.filter(F.col("token") != PRIOR), "token", F.col(key_col))
    sums = found.groupBy(key_col).agg(F.sum(F.col("n") * F.coalesce("weight", F.lit(0.0))).alias("__sum"))
    prior = weights.filter(F.col("token") == PRIOR).agg(F.max("weight").alias("__prior"))  # one row
    scored = df.select(key_col).join(sums, key_col, "left").join(F.broadcast(prior))
    score = F.coalesce("__sum", F.lit(0.0)) + F.coalesce("__prior", F.lit(0.0))
    return scored.select(key_col, score.alias("score"), (score >= 0).cast("int").alias("prediction"))
