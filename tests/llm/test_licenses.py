import re

from helpers import ascii_lower, rows_of

from credence.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def base_places(text):
    w = WORD.findall(ascii_lower(text))
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), places


def test_places_labels_and_scores(spark):
    rows = [
        (1, "Released under the MIT License. MIT\n-- license; mit x license"),
        (2, "The Apache License, GNU General Public License, MIT License"),
        (3, MIT), (4, MIT.replace("hereby ", "")),
        (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY 4.0."), (7, "cc by-sa 4 1"),
        (8, "This work is licensed under the GNU General Public License, version 3."),
        (9, "Licensed under the Apache License, Version 2.0."), (10, "GNU Lesser General Public License"),
        (11, None), (12, ""), (13, "émit license mité license mit licensé"), (14, "mit license " * 50_000), (15, "mit licenses submit license"),
    ] + [(100 + i, f"plain prose of the kind {i} in files") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS word", "'y' AS labels")
    got = {r["doc_id"]: r for r in rows_of(licenses.scan(docs))}
    for i, text in rows:
        n, places = base_places(text)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {i: got[i]["labels"] for i in range(1, 16)}
    assert labels == {1: "mit", 2: "apache,gpl,mit", 3: "mit-text", 4: "", 5: "cc-by-nc-4.0", 6: "cc-by-4.0", 7: "", 8: "gpl,gpl-3.0", 9: "apache,apache-2.0",
                      10: "gpl,lgpl", 11: "", 12: "", 13: "", 14: "mit", 15: ""}
    assert got[3]["score"] == got[9]["score"] == 1.0 and got[101]["score"] == 0.0


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "mit license"), (1, "apache license"), (None, "mit license"), (None, "x")]
    got = sorted(((r["doc_id"], r["labels"], r["n_base"]) for r in rows_of(licenses.scan(spark.createDataFrame(rows, SCHEMA)))), key=str)
    assert got == sorted([(1, "mit", 1), (1, "apache", 1), (None, "mit", 1), (None, "", 0)], key=str)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "mit license")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_only_anchor_words_are_looked_up(spark):
    """Candidates follow the rarest key word's places; the common words of a phrase give none."""
    rows = [(i, "license " * 400 + "mit") for i in range(20)] + [(100, "mit license general public license")] + [(200 + i, "license") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    words = docs.selectExpr("doc_id", "split(trim(text), ' ') AS __words")
    df = words.selectExpr("explode(array_distinct(__words)) AS word").groupBy("word").count().withColumnRenamed("count", "df")
    idx = licenses.index(spark, df, docs.selectExpr("count(*) AS n_docs")).cache()
    anchors = {r["template"]: r["word"] for r in idx.filter("anchor").collect()}
    assert anchors[0] == "mit" and anchors[1] == "apache" and anchors[2] in ("general", "public")
    placed = words.crossJoin(licenses.lookup_tables(idx)).withColumn("__candidates", licenses.candidates())
    got = {r["doc_id"]: r["c"] for r in placed.selectExpr("doc_id", "__candidates AS c").collect()}
    templates = {t for t, w in anchors.items() if w == "mit"}
    for i in range(20):  # 400 common words, one anchor word: one candidate a template, none for "license"
        assert {(c["template"]) for c in got[i]} == templates and len(got[i]) == len(templates)
    assert all(got[200 + i] == [] for i in range(30))


def test_edges_and_files_without_whole_phrase(spark):
    texts = ["license mit", "mit", "by 4 0 licensed under cc", "cc by 4 0", "under cc by 4 0", "license\x00mit license", "x " * 9 + "mit license"]
    got = {r["doc_id"]: r for r in rows_of(licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)))}
    assert [got[i]["n_base"] for i in range(7)] == [0, 0, 0, 0, 0, 1, 1]
    assert got[3]["labels"] == got[4]["labels"] == "cc-by-4.0" and got[2]["labels"] == ""  # positions outside the file match nothing
    assert got[3]["score"] < got[4]["score"] < 1.0 and (got[5]["first_word"], got[6]["first_word"]) == (1, 9)
