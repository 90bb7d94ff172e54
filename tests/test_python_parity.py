"""Property tests: Spark helpers agree with Python's float(), int(), str.strip(), re.findall."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.functions import rules
from credence.functions import text as tx

NUMERIC = st.lists(st.sampled_from(list("0123456789+-._eE ") + ["nan", "inf", "Infinity", "x", "\t", "1_0", "1.5"]), max_size=5).map("".join)
WS = st.text(alphabet=list(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　ab"),
             max_size=8)
TEXTS = st.text(alphabet=list("0123456789. mlozgkbfsLM, x"), max_size=30)
SETTINGS = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


def _py_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def _py_int(s):
    try:
        return int(s)
    except ValueError:
        return None


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b


@SETTINGS
@given(st.lists(NUMERIC, min_size=200, max_size=200))
def test_safe_casts_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", tx.safe_float("s").alias("f"), tx.safe_int("s").alias("i")).collect()
    for r in got:
        assert _same(r.f, _py_float(r.s)), r.s
        py_i = _py_int(r.s)
        if py_i is not None and abs(py_i) >= 2 ** 63:
            continue  # beyond BIGINT
        assert r.i == py_i, r.s


@SETTINGS
@given(st.lists(WS, min_size=200, max_size=200))
def test_strip_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", tx.py_strip("s").alias("t"), F.size(tx.split_words("s")).alias("n")).collect():
        assert r.t == r.s.strip()
        assert r.n == len(r.s.split())


@SETTINGS
@given(st.lists(TEXTS, min_size=200, max_size=200))
def test_capacity_matches_python_regex(spark, values):
    pattern = re.compile(r"(\d+(\.\d+)?)\s?(ml|oz|g|lbs|kg|mL|fl\s?oz|oz\.)")
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", rules.extract_capacity("s").alias("c")).collect():
        expected = [(float(m[0]), m[2]) for m in pattern.findall(r.s.lower())]
        assert [(c.amount, c.unit) for c in r.c] == expected, r.s
