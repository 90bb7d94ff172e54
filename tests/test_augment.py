"""Synthetic augmentation invariants."""

from pyspark.sql import functions as F

from credence.functions import rules
from credence.operators import augment


def test_random_info_invariants(spark):
    df = spark.range(2000).select(augment.random_review_info(11, F.col("id")).alias("i")).select("i.*")
    bad = df.where((F.col("total_pos_feedback_count") + F.col("total_neg_feedback_count") != F.col("total_feedback_count"))
                   | ~F.col("rating").isin(1, 5) | (F.col("total_feedback_count") > 5)
                   | ((F.col("rating") == 5) != (F.col("is_recommended") == 1))
                   | ((F.col("rating") == 5) != (F.col("review_title") == augment.TITLE_HIGH)))
    assert bad.count() == 0
    assert df.where("total_feedback_count = 0 AND helpfulness <> 0.0").count() == 0
    assert {r.rating for r in df.select("rating").distinct().collect()} == {1, 5}


def test_augment_text(spark):
    df = spark.createDataFrame([(str(i), "Good bad LOVE hate good, other") for i in range(50)], "k string, t string")
    out = [r.a.split(" ") for r in df.select(augment.augment_text(F.col("t"), 3, F.col("k")).alias("a")).collect()]
    allowed = {w for v in augment.SYNONYMS.values() for w in v} | {"good,", "other"}
    assert all(sorted(o) != sorted("Good bad LOVE hate good, other".split()) for o in out)
    assert all(set(o) <= allowed and len(o) == 6 for o in out)
    assert any(o[-1] != "other" for o in out)  # some rows are shuffled


def test_template_generator_output_is_valid(spark):
    cols = {"meta": F.struct(F.lit("Cream").alias("product_name"), F.lit("B").alias("brand_name"),
                             F.lit("[x]").alias("highlights")),
            "info": augment.random_review_info(1, F.lit("7"))}
    got = spark.range(1).select(augment.template_generator(cols, 0).alias("g"),
                                rules.format_valid(augment.template_generator(cols, 0)).alias("ok")).first()
    assert got.ok and got.g.startswith("Review title: ")


def test_batch_generator_calls(spark, tmp_path):
    """Prompts are counted through files, since the calls happen in other processes."""
    import os
    import uuid

    from conftest import SF_SMALL
    from credence.plans import catalog, jobs

    good = "Review title: t | Review text: x | Rating: 5 | Product summary: p by b. Highlights: h."

    def run(name, first_is_good):
        folder = str(tmp_path / name)
        os.makedirs(folder)

        def fake_llm(prompts, attempt):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{attempt} {len(prompts)}")
            return [good if attempt or first_is_good else "not the format" for _ in prompts]

        base = catalog._qlabels(spark, SF_SMALL).withColumn("meta", F.struct(*[
            F.lit(None).cast("string").alias(f) for f in augment.META_FIELDS]))
        rows = augment.synth_fakes(base, jobs.product_collection(spark, SF_SMALL), ratio=0.5, seed=1,
                                   generator=augment.batch_generator(fake_llm)).collect()
        assert rows and all(r.context == good for r in rows)
        calls = {}
        for f in os.listdir(folder):
            attempt, n = map(int, open(os.path.join(folder, f)).read().split())
            calls[attempt] = calls.get(attempt, 0) + n
        return len(rows), calls

    n, calls = run("valid", True)
    assert calls == {0: n}
    n, calls = run("retried", False)
    assert calls == {0: n, 1: n}


def test_batch_embedder(spark):
    import numpy as np

    from credence.operators import retrieval

    emb = retrieval.batch_embedder(lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    got = [r.v for r in retrieval.embed_texts(df, "t", "v", embedder=emb).collect()]
    assert got == [[3.0, 1.0], [0.0, 1.0]]


def test_plugins_load_once_a_task_and_bound_their_batches(spark, tmp_path):
    import os
    import uuid

    import pytest
    from credence.operators import retrieval

    folder = str(tmp_path)

    def note(kind, n):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{kind} {n}")

    def load_encoder():
        note("load", 1)

        def encode(texts):
            note("encode", len(texts))
            return [[len(t)] for t in texts]

        return encode

    df = spark.range(0, 1000, 1, 4).selectExpr("repeat('x', int(id % 7)) AS t", "id")
    out = df.select("id", retrieval.batch_embedder(dim=1, batch_size=30, load=load_encoder)(F.col("t")).alias("v")).collect()
    assert all(r.v == [float(r.id % 7)] for r in out) and len(out) == 1000
    notes = [open(os.path.join(folder, f)).read().split() for f in os.listdir(folder)]
    assert sum(k == "load" for k, _ in notes) == 4  # one a task
    sizes = [int(n) for k, n in notes if k == "encode"]
    assert max(sizes) <= 30 and sum(sizes) == 1000

    asked = []

    def model(prompts, attempt):
        asked.append((attempt, len(prompts)))
        good = "Review text: x Rating: 5 Product summary: p Highlights: h"
        return [good if int(p) % 3 <= attempt else None for p in prompts]

    answers = augment._answers(model, [str(i) for i in range(100)], 2, 16)
    assert [a is None for a in answers] == [i % 3 == 2 for i in range(100)]
    assert max(n for _, n in asked) <= 16 and sum(n for a, n in asked if a == 0) == 100 and sum(n for a, n in asked if a == 1) == 66
    assert augment._answers(model, [], 3, None) == []
    with pytest.raises(ValueError):
        augment._answers(lambda prompts, attempt: [], ["0"], 1, None)
    for plug in (augment.batch_generator, retrieval.batch_embedder):
        with pytest.raises(ValueError):
            plug()
