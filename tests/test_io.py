"""CSV / JSONL sources and sinks."""

import os
import tempfile

from credence.schemas import CONTEXT_RECORD_SCHEMA
from credence.sources import files


def test_csv_file_order_and_na(spark):
    d = tempfile.mkdtemp(prefix="credence-csv-")
    with open(os.path.join(d, "reviews_b.csv"), "w") as f:
        f.write('review_id,review_text,rating\nb0,"multi\nline, ""quoted""",NA\nb1,,5\n')
    with open(os.path.join(d, "reviews_a.csv"), "w") as f:
        f.write("review_id,review_text,rating\na0,first,nan\na1,second,None\na2,third,4\n")
    with open(os.path.join(d, "other.csv"), "w") as f:
        f.write("review_id\nzzz\n")
    rows = files.read_reviews_csv(spark, d).orderBy("pos").collect()
    assert [r.review_id for r in rows] == ["a0", "a1", "a2", "b0", "b1"]
    assert [r.rating for r in rows] == [None, None, "4", None, "5"]
    assert rows[3].review_text == 'multi\nline, "quoted"'
    assert rows[4].review_text is None
    assert [r.pos % files.POS_STRIDE for r in rows] == [0, 1, 2, 0, 1]


def test_products_csv_absent(spark):
    assert files.read_products_csv(spark, "/nonexistent/products.csv") is None


def test_jsonl_roundtrip_keeps_nulls(spark):
    d = tempfile.mkdtemp(prefix="credence-jsonl-")
    df = spark.createDataFrame([("r1", None, "ctx é", None, None)], CONTEXT_RECORD_SCHEMA)
    files.write_jsonl(df, d + "/out")
    text = "".join(open(os.path.join(d, "out", p), encoding="utf-8").read()
                   for p in os.listdir(d + "/out") if p.endswith(".json"))
    assert '"product_id":null' in text and "ctx é" in text
    back = files.read_jsonl(spark, d + "/out", CONTEXT_RECORD_SCHEMA)
    assert back.first().asDict() == df.first().asDict()


def test_limit_prefix(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    assert [r.pos for r in files.limit_prefix(df, 3).collect()] == [0, 1, 2]
    assert files.limit_prefix(df, 0).count() == 0
