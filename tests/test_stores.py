"""The stored collection, the duplicate split's files, the JSONL reader and the prompt's fixed text."""

import math

import pytest

from credence.operators import augment, collection, labeling, token_model
from credence.operators.scratch import folder
from credence.sources import files

ENTRY = "id string, document string, metadata struct<k:string>, embedding array<float>"


def entries(spark, ids):
    return spark.createDataFrame([(i, f"doc {i}", (i,), [1.0]) for i in ids], ENTRY)


def test_collection_appends_new_ids_once(spark):
    path = folder(spark, "collection")
    with pytest.raises(FileNotFoundError):
        collection.open_collection(spark, path)
    assert collection.append(spark, path, entries(spark, ["a", "b"]), buckets=4) == 2
    assert collection.append(spark, path, entries(spark, ["b", "c"]).selectExpr("id", "'new' AS document", "metadata", "embedding"), buckets=4) == 1
    assert collection.append(spark, path, entries(spark, ["a", "b", "c"]), buckets=4) == 0
    assert {(r["id"], r["document"]) for r in collection.open_collection(spark, path).collect()} == {("a", "doc a"), ("b", "doc b"), ("c", "new")}


def test_uncommitted_batches_are_not_seen(spark):
    """Rows of a job that died before its commit stay invisible, and its repetition adds them."""
    path = folder(spark, "collection")
    collection.append(spark, path, entries(spark, ["a"]), buckets=4)
    lost = entries(spark, ["z"]).selectExpr("*", "'lost' AS batch", "pmod(xxhash64(id), 4) AS bucket")
    lost.write.mode("append").partitionBy("bucket").parquet(f"{path}/data")
    assert [r["id"] for r in collection.open_collection(spark, path).collect()] == ["a"]
    assert collection.append(spark, path, entries(spark, ["z", "a"]), buckets=4) == 1
    assert sorted(r["id"] for r in collection.open_collection(spark, path).collect()) == ["a", "z"]


def test_duplicate_split_replaces_only_its_partitions(spark):
    path = folder(spark, "split")
    rows = spark.createDataFrame([(1, "x", "real", 0), (2, "x", "real", 1), (3, "y", "real", 2)], "id int, context string, pseudo_label string, pos long")
    flagged = labeling.flag_duplicates(rows)
    labeling.write_duplicate_split(flagged, path)
    labeling.write_duplicate_split(flagged.where("NOT is_duplicate AND id = 3"), path)  # no duplicates in this run
    kept, duplicates = labeling.read_duplicate_split(spark, path)
    assert sorted((r["id"], r["pseudo_label"]) for r in kept.collect()) == [(2, "fake"), (3, "real")]
    assert [(r["id"], r["pseudo_label"]) for r in duplicates.collect()] == [(2, "fake")]
    assert kept.columns == ["id", "context", "pseudo_label", "pos"]


def test_jsonl_skips_blank_lines_and_fails_on_others(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n   \n{"a": 2}\n')
    bad.write_text('{"a": 1}\n{"a": \n')
    schema = spark.createDataFrame([], "a int").schema
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(good), schema).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(bad), schema).collect()


def test_prompt_text():
    """The line of the product summary ends in a blank."""
    assert "Product summary: %s by %s. \nHighlights: %s.\nRating: %s.\n" in augment.PROMPT_TEMPLATE


def test_token_model_against_plain_counts(spark):
    texts = [(0, "good good cream", 1), (1, "bad cream", 0), (2, "Good, BAD!", 1), (3, None, 0), (4, "unseen", 7)]
    df = spark.createDataFrame(texts, "pos long, text string, label int")
    weights = {r["token"]: r["weight"] for r in token_model.fit(df).collect()}
    n1, n0, v = {"good": 3, "cream": 1, "bad": 1}, {"bad": 1, "cream": 1}, 3
    want = {t: math.log((n1.get(t, 0) + 1) / (5 + v) / ((n0.get(t, 0) + 1) / (2 + v))) for t in n1} | {"": math.log(3 / 3)}
    assert weights.keys() == want.keys() and all(abs(weights[t] - want[t]) < 1e-12 for t in want)
    fitted = token_model.fit(df)
    got = {r["pos"]: (r["score"], r["prediction"]) for r in token_model.predict(fitted, df).collect()}
    assert abs(got[0][0] - (2 * want["good"] + want["cream"])) < 1e-9 and got[3] == (0.0, 1) and got[4] == (0.0, 1) and got[1][1] == 0
    assert token_model.predict(fitted, df.limit(0)).count() == 0
    assert token_model.predict(token_model.fit(df.limit(0)), df).count() == 5


def test_token_model_learns(spark):
    rows = [(i, "awful terrible thing" if i % 2 else "lovely gentle thing", 1 - i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, text string, label int")
    found = token_model.predict(token_model.fit(df.filter("pos < 100")), df.filter("pos >= 100")).collect()
    assert all(r["prediction"] == 1 - r["pos"] % 2 for r in found)
