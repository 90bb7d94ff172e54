"""Results stay whole and exact when one key holds a third of all rows."""

from pyspark.sql import functions as F

from credence.operators import labeling, records, sampling
from credence.operators.skew import spread_lookup


def test_hot_duplicate_text(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}", "real") for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, context string, pseudo_label string").repartition(8)
    out = labeling.flag_duplicates(df)
    assert out.count() == 3000
    hot = out.where(F.col("context") == "hot text")
    assert hot.where("is_duplicate").count() == 999
    assert hot.where("NOT is_duplicate").first().pos == 0


def test_hot_class_ranks_are_dense(spark):
    sampling_target = sampling.TARGET_BUCKET_ROWS
    sampling.TARGET_BUCKET_ROWS = 50  # many buckets per class
    try:
        rows = [(i, "big" if i % 3 else "small") for i in range(3000)]
        df = spark.createDataFrame(rows, "pos long, pseudo_label string")
        ranked = sampling.hash_rank(df, 1, "pos", ["pseudo_label"], "r")
        stats = {r.pseudo_label: (r.n, r.lo, r.hi, r.d) for r in ranked.groupBy("pseudo_label").agg(
            F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"),
            F.countDistinct("r").alias("d")).collect()}
    finally:
        sampling.TARGET_BUCKET_ROWS = sampling_target
    assert stats == {"big": (2000, 1, 2000, 2000), "small": (1000, 1, 1000, 1000)}


def test_hot_product_join_keeps_rows(spark):
    reviews = spark.createDataFrame([(i, f"r{i}", "P1" if i % 3 == 0 else f"P{i % 50}", "t") for i in range(3000)],
                                    "pos long, review_id string, product_id string, review_text string")
    products = spark.createDataFrame([(i, f"P{i}", f"name {i}", "b", None) for i in range(50)],
                                     "pos long, product_id string, product_name string, brand_name string, "
                                     "highlights string")
    recs = records.review_records(reviews, products)
    assert recs.count() == 3000
    expected = sum(1 for i in range(3000) if ("P1" if i % 3 == 0 else f"P{i % 50}") == "P1")
    assert recs.where(F.col("context").contains("Product summary: name 1 by b")).count() == expected


def test_lookup_is_neither_broadcast_nor_repeated_whole(spark):
    """The lookup's rows are repeated for the salts that its key has only; a million keys of 8 MB by
    the planner's estimate do not pass the driver."""
    rows = spark.createDataFrame([(i, 7 if i % 3 == 0 else i) for i in range(300)] + [(300, -1), (301, None)], "pos long, key long")
    lookup = spark.range(1_000_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    out = spread_lookup(rows, lookup, "key", F.col("pos"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    got = {r.pos: r.v for r in out.collect()}
    assert got == {i: 14 if i % 3 == 0 else 2 * i for i in range(300)} | {300: None, 301: None}


def test_met_summaries_are_not_broadcast_at_run_time(spark):
    """The summaries that the reviews meet grow with the reviews: they are shuffled, however large the threshold."""
    reviews = spark.range(2000).selectExpr("id AS pos", "cast(id AS string) AS review_id", "concat('P', id % 40) AS product_id")
    products = spark.range(30).selectExpr("id AS pos", "concat('P', id) AS product_id", "concat('name ', id) AS product_name",
                                          "'b' AS brand_name", "'h' AS highlights")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        out = records.join_product_summary(reviews, products)
        got = sorted((r.pos, r.product_summary) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()  # as AQE ran it
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == [(i, f"name {i % 40} by b. Highlights: h." if i % 40 < 30 else None) for i in range(2000)]
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_labels_do_not_pass_the_driver(spark, tmp_path):
    """final_label joins two tables of a row per review, evaluate_explainer all labels: both shuffled,
    however large the threshold."""
    from credence.plans import catalog

    d = str(tmp_path)
    spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{d}/documents.parquet")
    spark.range(150).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand", "cast(id % 50 AS int) AS p_size",
                                "id + 0.5D AS p_retailprice").write.parquet(f"{d}/part.parquet")
    spark.range(0, 200, 2).selectExpr("id AS doc_id", "id % 4 AS quality", "0L AS toxic").write.parquet(f"{d}/labels.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        final, report = catalog.q_final_label(spark, d), catalog.q_evaluate_explainer(spark, d)
        assert sorted(int(r.review_id) for r in final.collect()) == list(range(200)) and report.count() > 0
        for df in (final, report):
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_queries_on_context_records_broadcast_nothing(spark, tmp_path):
    """One product a review: neither the summaries nor the entries pass the driver, however large the threshold."""
    from credence.plans import catalog

    d = str(tmp_path)
    spark.range(60).selectExpr("id AS doc_id", "concat('a 25 ml jar, paid 7.50 ', id) AS text").write.parquet(f"{d}/documents.parquet")
    spark.range(60).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand", "cast(id % 50 AS int) AS p_size",
                               "id + 0.5D AS p_retailprice").write.parquet(f"{d}/part.parquet")
    names = ["capacity_mismatch", "embed_texts", "explain_reviews", "extract_capacity", "extract_price", "factual_label", "format_valid"]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        for name in names:
            df = catalog.QUERIES[name](spark, d)
            assert {int(r.review_id) for r in df.collect()} == set(range(60)), name
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "isFinalPlan=true" in plan and "Broadcast" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
