import os

import duckdb
import public_tokenizers
import pytest
from helpers import SMALL, ascii_lower, jaccard_components, rows_of

import corpus_pipeline
from credence.llm import mixing, quality
from test_tokens import check_packing, ids_of


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of every stage on the smallest tables, with odd rows added."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(100_001, None, None, None, None), (100_002, "", "en", "src1", 0), (100_003, "one two", "en", None, 7), (100_004, "ONE TWO", "en", "src2", 7), (None, "no id " * 30, "en", "src2", 180), (100_005, "same row", "en", "src3", 8), (100_005, "same row", "en", "src3", 8)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("note", docs["lang"])
    out, at = [], str(tmp_path_factory.mktemp("pipeline"))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SMALL)
        result.write.parquet(os.path.join(at, name))
        result = spark.read.parquet(os.path.join(at, name))
        out.append((docs, result))
        docs = result
    return out


def key(r):
    return str(sorted(r.items(), key=str))


def test_stages_return_the_columns_of_documents(stages):
    for given, result in stages[:-1]:
        assert result.columns == given.columns


def test_classifier_stage(spark, stages):
    given, result = stages[0]
    model = quality.fit(given, spark.read.parquet(f"{SMALL}/labels.parquet"))
    accepted = sorted(str(r["doc_id"]) for r in rows_of(quality.score(given, model)) if r["accepted"])
    assert sorted(str(r["doc_id"]) for r in rows_of(result)) == accepted
    labels = duckdb.sql(f"SELECT doc_id FROM '{SMALL}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()
    kept = {r["doc_id"] for r in rows_of(result)}
    assert sum(d in kept for (d,) in labels) >= 0.9 * len(labels)


def test_exact_stage(stages):
    given, result = (rows_of(x) for x in stages[1])
    groups = {}
    for r in given:
        groups.setdefault(ascii_lower(r["text"]), []).append(r)
    want = []
    for rows in groups.values():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        want += [r for r in rows if r["doc_id"] == (max(ids) if ids else None)]
    assert sorted(map(key, result)) == sorted(map(key, want))


def test_near_stage(stages):
    given, result = (rows_of(x) for x in stages[2])
    docs = {r["doc_id"]: r["text"] for r in given if r["doc_id"] is not None}
    _, component = jaccard_components(docs, 5, 80)
    want = [r for r in given if r["doc_id"] is None or component[r["doc_id"]] == r["doc_id"]]
    assert sorted(map(key, result)) == sorted(map(key, want))


def test_mixing_stage(stages):
    given, result = stages[3]
    plan = {}
    for r in rows_of(mixing.mix_plan(given)):
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    counts = {r["doc_id"]: r["count"] for r in rows_of(result.groupBy("doc_id").count())}
    assert counts == {d: c for d, c in plan.items() if c}
    assert {key(r) for r in rows_of(result)} <= {key(r) for r in rows_of(given)}


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given, result = (rows_of(x) for x in stages[4])
    copies = {}
    for r in given:
        copies.setdefault(r["doc_id"], []).append([*ids_of(lib, r["text"]), 1])
    pieces = {}
    for r in result:
        pieces.setdefault(r["doc_id"], []).append(r)
    numbered, ids = [], {}
    for d, texts in copies.items():  # equal rows: any assignment of equal pieces to copies is one
        by_start = {}
        for p in pieces[d]:
            by_start.setdefault((p["start"], p["length"]), []).append(p)
        for n, text in enumerate(texts):
            ids[d, n] = text
        seen = dict.fromkeys(range(len(texts)), 0)
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            n = next(n for n in seen if seen[n] == p["start"])
            seen[n] += p["length"]
            numbered.append({**p, "doc_id": (d, n)})
    check_packing(numbered, ids)


def test_run_is_registered_and_equals_the_stages(spark, stages):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is not None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"
    out = corpus_pipeline.run(spark, SMALL)
    assert set(out.columns) == {"doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"} and out.count() > 0
