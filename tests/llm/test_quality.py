import random

import duckdb
import pytest
from helpers import rows_of

from credence.llm import quality

DOC = "doc_id long, text string, lang string, source string, n_chars int, extra string"
SF = "/root/testdata/sf0.1"


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["good"] * 4 + ["junk", "toxic"])
        ws = [word() for _ in range(rng.randrange(30, 200))]
        if kind == "junk":
            ws = [w.upper() + "!!" for w in ws]
        if kind == "toxic":
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["nasty", "vile"]))
        text = " ".join(ws)
        rows.append((i, text, "en", f"s{i % 5}" if kind == "good" else "s9", len(text), "e"))
        labels.append((i, kind, 0 if kind == "junk" else 1, 1 if kind == "toxic" else 0))
    return rows, labels


def test_learns_and_keeps_clean_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    known = spark.createDataFrame([(i, q, t) for i, _, q, t in labels if i % 2], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    got = {r["doc_id"]: r for r in rows_of(quality.score(docs, model))}
    held = [(i, kind) for i, kind, _, _ in labels if i % 2 == 0]
    clean = [got[i]["accepted"] for i, k in held if k == "good"]
    bad = [got[i]["accepted"] for i, k in held if k != "good"]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.1 * len(bad)
    kept = quality.keep(docs, model)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert {r["doc_id"] for r in rows_of(kept)} == {i for i, r in got.items() if r["accepted"]}
    again = quality.fit(docs.repartition(3), known)
    assert all((model[t].text == again[t].text).all() and model[t].limit == again[t].limit for t in quality.TARGETS)


def test_odd_rows_no_labels_empty_table(spark):
    rows, labels = corpus(200)
    odd = [(1000, None, None, None, None, None), (1001, "", "", "", -5, ""), (1002, "word " * 100_000, "xx", "new", 500_000, "x"), (None, "a b", "en", "s1", 3, ""), (5, rows[5][1], "en", "s0", 9, "")]
    docs = spark.createDataFrame(rows + odd, DOC)
    known = spark.createDataFrame([(i, q, t) for i, _, q, t in labels] + [(None, 1, 0), (3, None, None), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    scored = rows_of(quality.score(docs, quality.fit(docs, known)))
    assert len(scored) == len(rows) + len(odd) and all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in scored)
    nothing = quality.fit(docs, known.limit(0))
    assert all(r["accepted"] for r in rows_of(quality.score(docs, nothing)))
    none = docs.limit(0)
    assert quality.score(none, quality.fit(none, known)).count() == 0


@pytest.mark.parametrize("column,bad", [("quality", 0), ("toxic", 1)])
def test_held_out_accuracy(spark, column, bad):
    """Fitted on half of the labelled rows, measured on the other half."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.fit(docs, labels.filter("doc_id % 2 = 0"))).toArrow()  # noqa: F841
    held = duckdb.sql(f"SELECT l.quality, l.toxic, g.accepted FROM got g JOIN '{SF}/labels.parquet' l USING (doc_id) WHERE doc_id % 2 = 1").fetchall()
    clean = [a for q, t, a in held if q == 1 and t == 0]
    rejected = [not a for q, t, a in held if (q if column == "quality" else t) == bad]
    assert sum(clean) >= 0.97 * len(clean) and sum(rejected) >= 0.7 * len(rejected)


def test_pseudo_labels_come_from_all_unlabelled_documents(spark, monkeypatch):
    """Rounds draw anew over all documents without a label; a null label or id counts as none."""
    rows, labels = corpus(2400)
    rows.append((None, *rows[0][1:]))
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    known = [(i, q, t) for i, _, q, t in labels if i % 4 == 0] + [(1, None, None), (2, 1, None)]
    drawn, draw = [], quality._draw
    unlabelled = []

    def spy(rows, name, views, *rest):
        unlabelled.append(rows.count())
        drawn.append(draw(rows, name, views, *rest))
        return drawn[-1]

    monkeypatch.setattr(quality, "_draw", spy)
    quality.fit(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), pool=60)
    assert set(unlabelled) == {1801} and len(drawn) == 2 * quality.ROUNDS - 1
    for t in quality.TARGETS:
        sets = [set(d[t].column("key").to_pylist()) for d in drawn]
        assert all(0 < len(s) < 2 * 60 + 60 for s in sets) and len(set.union(*sets)) > 2 * 60 + 60
    assert quality.PER_CLASS == quality.POOL == 4000
