"""Truth tables for the credibility rules; expected values derived by hand from the
pipeline's definitions (Python semantics: str.strip, float(), int(), re)."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from credence.functions import rules
from credence.functions import text as tx
from credence.schemas import META_FIELDS


def one(spark, col, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    (" 1.5 ", 1.5), ("1_000", 1000.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("+2", 2.0),
    ("inf", math.inf), ("-Infinity", -math.inf), ("1d", None), ("abc", None), ("", None), ("1__0", None),
    (" 1.25 ", 1.25), (None, None),
])
def test_safe_float(spark, raw, expected):
    got = one(spark, tx.safe_float, raw)
    assert got == expected


def test_safe_float_nan(spark):
    assert math.isnan(one(spark, tx.safe_float, "nan"))
    assert math.isnan(one(spark, tx.safe_float, "NaN"))


@pytest.mark.parametrize("raw,strict,expected", [
    ("1.0", True, None), ("1.0", False, 1), (" 7 ", True, 7), ("+3", True, 3), ("1_0", True, 10), ("", True, None),
    ("2.9", False, 2), ("-2.9", False, -2), ("nan", False, None),
])
def test_safe_int(spark, raw, strict, expected):
    assert one(spark, lambda c: tx.safe_int(c, strict=strict), raw) == expected


def test_py_strip(spark):
    assert one(spark, tx.py_strip, "  x y  \n") == "x y"
    assert one(spark, tx.py_strip, "\x1c x") == "x"
    assert one(spark, tx.py_strip, "   ") == ""


def test_extract_capacity(spark):
    caps = one(spark, rules.extract_capacity, "I bought 5 great 200ml and 1.7 fl oz, 3 oz. 2 KG")
    assert [(c["amount"], c["unit"]) for c in caps] == [(5.0, "g"), (200.0, "ml"), (1.7, "fl oz"), (3.0, "oz"),
                                                        (2.0, "kg")]
    ml = one(spark, rules.capacities_ml, "5 great 200ml 1.7 fl oz 3 oz 2 kg 1 lbs")
    assert ml == pytest.approx([5.0, 200.0, 1.7, 3 * 29.5735, 2000.0, 453.592])


def test_extract_price(spark):
    assert one(spark, rules.extract_price, "I paid $10.999 for 2 jars") == 10.99
    assert one(spark, rules.extract_price, "no numbers") is None


def _cap(spark, review, size):
    df = spark.createDataFrame([(review, size)], "r string, s string")
    return df.select(rules.capacity_mismatch(rules.capacities_ml(F.col("r")), F.col("s")).alias("y")).first()["y"]


def test_capacity_mismatch(spark):
    assert _cap(spark, "the 25 ml jar", "1.7 oz/ 50 mL") is False   # 25 vs 50.27 and 50: some pair is close
    assert _cap(spark, "a 200 ml tube", "10 ml") is True
    assert _cap(spark, "a 200 ml tube", "10 ml, 180 ml") is False  # one close pair is enough
    assert _cap(spark, "no size here", "10 ml") is False
    assert _cap(spark, "a 200 ml tube", "") is False
    assert _cap(spark, "a 100 ml tube", "30 ml") is True            # differs by 70: > 6 and > 50


def test_capacity_boundaries(spark):
    # |c-p| must exceed both 20% of p and 50 ml.
    assert _cap(spark, "120 ml", "60 ml") is True    # 60 > 12 and 60 > 50
    assert _cap(spark, "110 ml", "60 ml") is False   # 50 is not > 50
    assert _cap(spark, "400 ml", "300 ml") is True   # 100 > 60 and > 50
    assert _cap(spark, "350 ml", "300 ml") is False  # 50 not > 60


def _scope(spark, fn, text, h):
    df = spark.createDataFrame([(text, h)], "t string, h string")
    return df.select(fn(F.lower(F.col("t")), F.col("h")).alias("y")).first()["y"]


def test_skin_and_gender(spark):
    assert _scope(spark, rules.skin_type_mismatch, "My oily skin", "[best for dry skin]") is True
    assert _scope(spark, rules.skin_type_mismatch, "My oily skin", "[Good for: Dryness]") is False  # case kept
    assert _scope(spark, rules.skin_type_mismatch, "so dry", "[best for oily skin]") is True
    assert _scope(spark, rules.gender_mismatch, "great for men", "[Treatment for women]") is True
    assert _scope(spark, rules.gender_mismatch, "great for men", "[unisex, Clean]") is False
    assert _scope(spark, rules.gender_mismatch, "Recommended: 1.0", "[for men]") is True  # substring trap
    assert _scope(spark, rules.gender_mismatch, "nothing", "[for men]") is False


def test_online_only(spark):
    df = spark.createDataFrame([("I bought in store today", "0"), ("bought in stores", "1"), ("bought in store", ""),
                                ("went to the store.", "1"), ("in-store purchase", None)], "t string, o string")
    got = [r.y for r in df.select(rules.online_only_mismatch(F.lower(F.col("t")), F.col("o")).alias("y")).collect()]
    assert got == [True, False, False, True, False]


META_SCHEMA = StructType([StructField(f, StringType()) for f in META_FIELDS])


def _score(spark, rows, missing="nan", strict=True):
    schema = StructType([StructField("context", StringType()), StructField("meta", META_SCHEMA)])
    data = [(c, {**{f: None for f in META_FIELDS}, **m}) for c, m in rows]
    df = spark.createDataFrame(data, schema)
    df = rules.with_fake_score(df, "s", missing=missing, strict_int=strict)
    return [r.s for r in df.collect()]


def test_fake_score_rules(spark):
    ctx15 = "Review text: ok"                 # 15 chars
    ctx30 = "x" * 30
    ctx45 = "y" * 45
    ctx70 = "z" * 70
    got = _score(spark, [
        (ctx15, {"rating": "5"}),                                                        # R1: +2
        (ctx30, {"rating": "5", "total_feedback_count": "0", "is_recommended": "0"}),     # R3 +1, R5 +1
        (ctx70, {"rating": "3", "helpfulness": "0.29", "total_feedback_count": "3"}),    # R2 +1
        (ctx70, {"rating": "3", "helpfulness": "0.3", "total_feedback_count": "3"}),     # no R2
        (ctx70, {"rating": "3", "helpfulness": "0.1", "total_feedback_count": "25",
                 "total_neg_feedback_count": "16"}),                                      # R2 +1, R2a +1
        (ctx70, {"rating": "3", "helpfulness": "0.1", "total_feedback_count": "24",
                 "total_neg_feedback_count": "17"}),                                      # 0.708 > 0.7 -> +2
        (ctx70, {"rating": "1", "helpfulness": "0.1", "total_feedback_count": "5",
                 "total_neg_feedback_count": "5"}),                                       # R2+R2c+R4 -> 3
        (ctx70, {"rating": "1", "is_recommended": "1.0"}),                               # '1.0' is not an int
        (ctx70, {"rating": "4.5", "is_recommended": "0"}),                               # R5 +1
        ("", {"rating": "5"}),                                                            # no text
        ("   ", {"rating": "5"}),
        (ctx70, {"rating": "2", "total_feedback_count": "4", "total_neg_feedback_count": None}),  # neg NULL -> 0
    ])
    assert got == [2.0, 2.0, 1.0, 0.0, 2.0, 2.0, 3.0, 0.0, 1.0, math.inf, math.inf, 0.0]


def test_fake_score_missing_rating(spark):
    rows = [("a" * 15, {}), ("b" * 45, {}), ("c" * 70, {}), ("d" * 70, {"rating": "abc"})]
    assert _score(spark, rows, missing="null") == [math.inf, 2.0, 1.0, 1.0]
    # NaN semantics: a NULL rating takes the rated branch with every rating test false.
    assert _score(spark, rows, missing="nan") == [0.0, 0.0, 0.0, 1.0]


def test_strict_int_option(spark):
    assert _score(spark, [("c" * 70, {"rating": "1", "is_recommended": "1.0"})], strict=False) == [1.0]


def test_final_label(spark):
    schema = StructType([StructField("fact", StringType()), StructField("score", StringType()),
                         StructField("context", StringType()), StructField("meta", META_SCHEMA)])
    m = {f: None for f in META_FIELDS}
    rows = [("fake", "0", "x" * 80, {**m, "rating": "5"}), ("real", "3", "x" * 80, {**m, "rating": "5"}),
            ("real", "2", "x" * 80, {**m, "rating": "5"}), ("real", "2", "x" * 59, {**m, "rating": "5"}),
            ("real", "1", "x" * 80, {**m, "rating": "abc"}), ("real", "1", "x" * 80, m),
            ("real", "inf", "x" * 80, {**m, "rating": "5"})]
    df = spark.createDataFrame(rows, schema)
    got = [r.y for r in df.select(rules.final_label(F.col("fact"), F.col("score").cast("double"), F.col("context"),
                                                    F.col("meta")).alias("y")).collect()]
    assert got == ["fake", "fake", "real", "fake", "fake", "real", "fake"]
    got_null = [r.y for r in df.select(rules.final_label(F.col("fact"), F.col("score").cast("double"),
                                                         F.col("context"), F.col("meta"), "null").alias("y")).collect()]
    assert got_null[5] == "fake"


def test_parsers(spark):
    assert one(spark, rules.parse_label, "Label: REAL. reason: fine") == "real"
    assert one(spark, rules.parse_label, "nothing here") == "fake"
    got = one(spark, rules.parse_explanation, "label: real. reason: Fine detail.\nmore")
    assert (got["label"], got["reason"]) == ("Real", "Fine detail.")
    got = one(spark, rules.parse_explanation, "no label at all")
    assert (got["label"], got["reason"]) == ("fake", rules.REASON_FALLBACK)
    got = one(spark, rules.parse_explanation, "LABEL:  FAKE reason:")
    assert (got["label"], got["reason"]) == ("Fake", rules.REASON_FALLBACK)


def test_format_valid(spark):
    ok = "Review text: a | Rating: 5 | Product summary: x by y. Highlights: z."
    assert one(spark, rules.format_valid, ok) is True
    assert one(spark, rules.format_valid, "Review text: a | Rating: 5") is False


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([2.0, 1.0],)], "a array<double>")
    assert [r.y for r in df.select(rules.argmax_array(F.col("a")).alias("y")).collect()] == [1, 0]
