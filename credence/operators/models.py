"""Classifier training / evaluation with Spark ML, and the rule-backed explainer.

The reference fine-tunes a transformer; here the same table contract (text -> 0/1, fake=0)
is served by a distributed Spark ML pipeline: tokenise the whole text -> hashed
term frequencies -> IDF -> logistic regression. Fitting is a handful of tree-aggregated
passes over the data; prediction is a map-only transform.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import rules
from credence.operators import dataset, metrics, sampling
from credence.sources import files

NUM_FEATURES = 1 << 18


def classifier_pipeline(num_features: int = NUM_FEATURES, reg: float = 0.01,
                        max_iter: int = 50) -> Pipeline:
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[tok, tf, idf, lr])


def train_classifier(examples: DataFrame, test_fraction: float = 0.1, seed: int = 0, key: str = "pos",
                     **pipeline_kw) -> tuple[PipelineModel, DataFrame]:
    """Fit on a seeded hash split of ``examples`` (``text, label`` + ``key``); returns the
    model and its accuracy / macro-F1 / weighted-F1 on the held-out part."""
    split = sampling.random_split(examples, test_fraction, seed, key)
    train = split.where(F.col("split") == "train").select("text", F.col("label").cast("double").alias("label"))
    test = split.where(F.col("split") == "test")
    model = classifier_pipeline(**pipeline_kw).fit(train)
    return model, metrics.metrics_summary(predict(model, test))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds integer ``prediction`` (argmax of the model's scores)."""
    keep = [c for c in df.columns if c not in ("prediction", "rawPrediction", "probability")]
    out = model.transform(df.select(*keep).withColumn("text", F.coalesce(F.col("text"), F.lit(""))))
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def evaluate_classifier(model: PipelineModel, records: DataFrame, label_col: str = "pseudo_label",
                        text_col: str = "context", max_rows: int | None = None, pos: str = "pos") -> DataFrame:
    """Classification report of ``model`` on labelled records (unknown labels count as real).
    ``max_rows`` (truthy) caps the rows in file order before labels are read."""
    if max_rows:
        records = files.limit_prefix(records, max_rows, pos)
    ex = dataset.encode_labels_lenient(records, label_col, text_col)
    return metrics.classification_report(predict(model, ex))


def predict_requests(model: PipelineModel, contexts: DataFrame) -> DataFrame:
    """Verdict text of the model for a table of request contexts (``review_id, context``)."""
    scored = predict(model, contexts.withColumn("text", F.col("context")))
    return scored.select("review_id", "context", "prediction", rules.verdict_text(F.col("prediction")).alias("verdict"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------------------------------
# Explainer
# ---------------------------------------------------------------------------------------
# Names of the rules reported in an explanation, in report order.
REASON_NAMES = ["skin_type", "gender", "capacity", "online_only", "heuristic_score", "too_short_or_unrated"]


def explain_reviews(df: DataFrame, label_col: str = "pseudo_label") -> DataFrame:
    """Explanation per review: the label's reason sentence, the generated-style text
    ``label: <l>. reason: <r>``, and the list of rules that fired. Needs the boolean
    columns named in ``REASON_NAMES`` (missing ones count as false)."""
    fired = F.array(*[F.when(F.coalesce(F.col(n), F.lit(False)) if n in df.columns else F.lit(False), F.lit(n))
                      for n in REASON_NAMES])
    lab = F.col(label_col)
    out = df.withColumn("reason", rules.reason_for(lab)).withColumn(
        "explanation", rules.explainer_target(lab, F.col("reason")))
    return out.withColumn("rules_fired", F.array_join(F.filter(fired, lambda x: x.isNotNull()), ","))


def evaluate_explainer(explained: DataFrame, label_col: str = "pseudo_label", text_col: str = "explanation") -> DataFrame:
    """Classification report of generated explanations: records with a valid label, the label parsed
    from the text (``fake`` where it has none) against the record's (fake 0, real 1)."""
    valid = explained.where(F.col(label_col).isin("real", "fake"))
    code = lambda c: F.when(c == "fake", 0).otherwise(1)
    return metrics.classification_report(valid.select(
        code(F.col(label_col)).alias("label"), code(rules.parse_label(F.col(text_col))).alias("prediction")))


def rule_flags(df: DataFrame, own_col: str = "own") -> DataFrame:
    """Per-rule booleans of a review against one product struct (``id, document, metadata``)
    plus the heuristic score, for ``explain_reviews``. Three projections: parsed inputs,
    then the rule flags and score, then the label."""
    base = [c for c in df.columns if c not in REASON_NAMES + ["fake_score", "pseudo_label", "__f", "__si"]]
    staged = df.select(*base, rules.review_features(F.col("context")).alias("__f"),
                       rules.score_inputs(F.col("context"), F.col("meta")).alias("__si"))
    f, meta = F.col("__f"), F.col(f"{own_col}.metadata")
    h = F.coalesce(meta["highlights"], F.lit(""))
    has = lambda c, w: F.coalesce(F.contains(c, F.lit(w)), F.lit(False))
    gendered = has(h, "men") | has(h, "women") | has(h, "unisex") | has(h, "gender-neutral") | has(h, "genderless")
    score = rules.score_from(F.col("__si"))
    flagged = staged.select(
        *base,
        ((f["oily"] & has(h, "dry")) | (f["dry"] & has(h, "oily"))).alias("skin_type"),
        (f["men"] & gendered & ~has(h, "unisex") & ~has(h, "genderless")).alias("gender"),
        F.coalesce(rules.capacity_mismatch(f["ml"], meta["size"]), F.lit(False)).alias("capacity"),
        F.coalesce(meta["online_only"].isNotNull() & (meta["online_only"] != "") & f["store"],
                   F.lit(False)).alias("online_only"),
        score.alias("fake_score"),
        (score > F.lit(float(rules.FAKE_THRESHOLD))).alias("heuristic_score"),
        (~((F.length(F.coalesce(F.col("context"), F.lit(""))) >= rules.MIN_REAL_CONTEXT_CHARS)
           & F.col("__si.has_rating"))).alias("too_short_or_unrated"),
    )
    own_fact = F.col(own_col).isNotNull() & (F.col("skin_type") | F.col("gender") | F.col("capacity")
                                             | F.col("online_only"))
    fake = own_fact | F.col("heuristic_score") | F.col("too_short_or_unrated")
    return flagged.select("*", F.when(fake, F.lit("fake")).otherwise(F.lit("real")).alias("pseudo_label"))
