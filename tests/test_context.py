"""Context text building and parsing (golden-style examples)."""

from pyspark.sql import functions as F

from credence.functions import context as ctxf
from credence.operators import records

REVIEW_COLS = ["pos", "review_id", "product_id", "rating", "is_recommended", "review_title", "review_text"]


def _reviews(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'pos' else 'string'}" for c in REVIEW_COLS))


def _products(spark, rows):
    cols = ["pos", "product_id", "product_name", "brand_name", "highlights"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'pos' else 'string'}" for c in cols))


def test_context_examples(spark):
    text1 = "Great product. Size of 25 ml will last you almost a month."
    text2 = "they leave my face very fresh and clean and never oily!"
    rv = _reviews(spark, [
        (0, None, "p1", "5", "1.0", None, text1),
        (1, None, "p2", "5", "1.0", "LOVE", text2),
        (2, "r3", "p3", "5", None, "Love it!", "sensitive and dry skin"),
        (3, "r4", "missing", None, None, None, None),
    ])
    pr = _products(spark, [(0, "p1", "Aqua Cream", "brandA", None),
                           (1, "p2", "Milk Cleanser", "brandB", "['Clean', 'Good for: Dryness', 'Vegan']"),
                           (2, "p3", "Argan Oil", "brandC", "['Vegan']"),
                           (3, "p3", "Argan Oil v2", "brandC", "['Vegan', 'New']")])  # duplicate id: last wins
    got = {r.pos: r.context for r in records.review_records(rv, pr).collect()}
    assert got[0] == (f"Review text: {text1} | Rating: 5 | Recommended: 1.0 | "
                      "Product summary: Aqua Cream by brandA. Highlights: nan.")
    assert got[1] == (f"Review title: LOVE | Review text: {text2} | Rating: 5 | Recommended: 1.0 | "
                      "Product summary: Milk Cleanser by brandB. Highlights: ['Clean', 'Good for: Dryness', 'Vegan'].")
    assert got[2] == ("Review title: Love it! | Review text: sensitive and dry skin | Rating: 5 | "
                      "Product summary: Argan Oil v2 by brandC. Highlights: ['Vegan', 'New'].")
    assert got[3] == "Review text: nan"


def test_parse_context(spark):
    ctxs = [
        "Review text: Great. Size 25 ml. | Rating: 5 | Recommended: 1.0 | Product summary: Aqua Cream by brandA. "
        "Highlights: nan.",
        "Review title: Love it! | Review text: dry skin | Rating: 5 | Product summary: Oil by night by brandC. "
        "Highlights: ['Vegan'].",
    ]
    df = spark.createDataFrame([(c,) for c in ctxs], "c string")
    got = [r.p.asDict() for r in df.select(ctxf.parse_context(F.col("c")).alias("p")).collect()]
    assert got[0] == {"review_title": "", "review_text": "Great. Size 25 ml.", "product_name": "Aqua Cream",
                      "recommended": "1.0"}
    assert got[1] == {"review_title": "Love it!", "review_text": "dry skin", "product_name": "Oil by night",
                      "recommended": "0.0"}


def test_product_document_and_metadata(spark):
    pr = spark.createDataFrame([(0, "", "Cream", None, "", "10", None, "", "0")],
                               "pos long, product_id string, product_name string, brand_name string, size string, "
                               "price_usd string, value_price_usd string, sale_price_usd string, online_only string")
    e = records.product_entries(pr).first()
    assert e.id == "prod_0"
    assert e.document == ("Product Name: Cream. Product ID: . Brand: . Size: . Price: $10. Value Price: $. "
                          "Sale Price: $. Online Only: 0")
    assert e.metadata.value_price_usd == "10" and e.metadata.sale_price_usd == "10"
    assert e.metadata.highlights == "" and e.metadata.reviews == "0"


def test_request_context(spark):
    c = ctxf.request_context(F.lit("T"), F.lit("txt"), F.lit(False), F.lit("4"), F.lit("N"), F.lit("B"),
                             F.lit(None).cast("string"))
    got = spark.range(1).select(c.alias("c")).first().c
    assert got == "Review title: T | Review text: txt | Rating: 4 | Recommended: 0.0 | Product summary: N by B. " \
                  "Highlights: nan."
