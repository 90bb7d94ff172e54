"""Classification metrics as aggregates: accuracy, macro/weighted F1, classification report.

Everything reduces the data once to a confusion table (``groupBy(label, prediction)``,
partial aggregation map-side, at most classes^2 rows) and derives the rest from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.operators.labeling import running_sums

REPORT_DIGITS = 4


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class (present in truth or predictions): tp, support, predicted, precision, recall, f1.

    One pass: every confusion cell contributes to its true class and to its predicted class
    (an explode of two entries), then one group-by over at most classes^2 rows."""
    c = confusion(df, label, prediction)
    n, same = F.col("n"), F.col("label") == F.col("prediction")
    parts = F.array(
        F.struct(F.col("label").alias("cls"), n.alias("support"), F.when(same, n).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), n.alias("predicted")),
    )
    j = c.select(F.explode(parts).alias("p")).groupBy(F.col("p.cls").alias("cls")).agg(
        F.sum("p.support").alias("support"), F.sum("p.tp").alias("tp"), F.sum("p.predicted").alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    den = 2 * F.col("tp") + (F.col("predicted") - F.col("tp")) + (F.col("support") - F.col("tp"))
    f1 = F.when(den > 0, 2 * F.col("tp") / den).otherwise(F.lit(0.0))
    return j.select("cls", "support", "tp", "predicted", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def metrics_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: ``accuracy, macro_f1, weighted_f1, n``."""
    pc = per_class(df, label, prediction)
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = REPORT_DIGITS) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg``, ``weighted avg``; zero division -> 0.

    The input is read once: the summary rows come from window aggregates over the
    per-class table (a handful of rows) and are emitted by the first class row."""
    every = Window.partitionBy()
    pc = per_class(df, label, prediction).select(
        "*",
        F.sum("support").over(every).alias("__tot"),
        F.sum("tp").over(every).alias("__tp"),
        F.avg("precision").over(every).alias("__mp"), F.avg("recall").over(every).alias("__mr"),
        F.avg("f1").over(every).alias("__mf"),
        F.sum(F.col("precision") * F.col("support")).over(every).alias("__wp"),
        F.sum(F.col("recall") * F.col("support")).over(every).alias("__wr"),
        F.sum(F.col("f1") * F.col("support")).over(every).alias("__wf"),
        (F.row_number().over(Window.orderBy("cls")) == 1).alias("__first"),
    )
    r = lambda c: F.round(c, digits)
    tot = F.col("__tot")

    def row(name, p, rc, f, sup):
        return F.struct(name.alias("class"), p.alias("precision"), rc.alias("recall"), f.alias("f1"),
                        sup.cast("bigint").alias("support"))

    none = F.lit(None).cast("double")
    own = row(F.col("cls").cast("string"), r(F.col("precision")), r(F.col("recall")), r(F.col("f1")), F.col("support"))
    summary = F.array(
        row(F.lit("accuracy"), none, none, r(F.col("__tp") / tot), tot),
        row(F.lit("macro avg"), r(F.col("__mp")), r(F.col("__mr")), r(F.col("__mf")), tot),
        row(F.lit("weighted avg"), r(F.col("__wp") / tot), r(F.col("__wr") / tot), r(F.col("__wf") / tot), tot),
    )
    empty = F.array().cast("array<struct<class:string,precision:double,recall:double,f1:double,support:bigint>>")
    rows = F.concat(F.array(own), F.when(F.col("__first"), summary).otherwise(empty))
    return pc.select(F.explode(rows).alias("row")).select("row.*")


def running_accuracy(df: DataFrame, pos: str = "pos", label: str = "label", prediction: str = "prediction",
                     bucket_rows: int = 1 << 20) -> DataFrame:
    """Per row, the accuracy of all rows up to it in ``pos`` order (bucketed prefix sums)."""
    correct = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    out = running_sums(df, pos, {"__c": correct, "__t": F.lit(1)}, bucket_rows)
    return out.withColumn("running_accuracy", F.col("__c") / F.col("__t")).drop("__c", "__t")


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.countDistinct(label).alias("num_labels"))


__all__ = ["confusion", "per_class", "metrics_summary", "classification_report", "running_accuracy",
           "distinct_labels"]
