import collections
import random
import re
import zlib

import pytest
from helpers import ascii_lower, small_docs  # noqa: F401
from pyspark.sql import functions as F

from credence.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(w, v):
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v, strict=True)) == 1
    w, v = sorted((w, v), key=len)
    return len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))


def brute(counts, ratio=10):
    """{word: n} -> {word: (form, root, n, n_near, form_n)} by comparing every pair."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def forms_of(df):
    return {r["word"]: tuple(r[c] for c in COLUMNS[1:]) for r in df.select(*COLUMNS).collect()}


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = ["aab", "abcé", "aÀÿb"][seed]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(250)}
    counts = {w: rng.choice([1, 1, 2, 3, 10, 20, 30, 300, 3000]) for w in words}
    assert forms_of(spelling.variant_forms(counted(spark, counts).repartition(5))) == brute(counts)


def test_runs_ties_and_chains(spark):
    counts = {"aaaaaaa": 1, "aaaaaaaa": 10, "aaaaaaaaa": 10, "baaaaaaa": 10, "aaaaaaac": 100, "aaaaaabc": 1000, "aaaaabbc": 10000}
    got = forms_of(spelling.variant_forms(counted(spark, counts)))
    assert got == brute(counts)
    assert got["aaaaaaa"][:2] == ("aaaaaaac", "aaaaabbc") and got["aaaaaaa"][3] == 3
    tie = {"aaaaaaa": 1, "aaaaaaab": 10, "aaaaaaac": 10, "aaaaaada": 10}
    assert forms_of(spelling.variant_forms(counted(spark, tie)))["aaaaaaa"][0] == "aaaaaaab"


def test_ranges_cut_by_batches(spark):
    counts = {f"prefix{c}tail": 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäå")} | {"prefixtail": 500}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert forms_of(spelling.variant_forms(counted(spark, counts))) == brute(counts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_no_rotation_is_lost_or_paired(spark):
    """2L + 1 rows a word, and a range's members grow by its size, not by its pairs."""
    words = counted(spark, {f"{c}ometimes": 5 for c in "abcdefghijklmnopqrstuvwxyz"})
    assert spelling.rotations(words).count() == 26 * 19
    found = spelling.neighbours(words).collect()
    assert len(found) == 26 and all(r["n_near"] == 25 for r in found)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "Strasse, STRASSE! Größe", "x"), (3, "größere größere GRÖßERE " + "letters" * 20000, "x"), (3, "größere", "y")],
        "doc_id long, text string, word string")
    found = spelling.runs(docs)
    assert found.columns == ["doc_id", "word"]
    rows = collections.Counter((r["doc_id"], r["word"]) for r in found.collect())
    # Ö is not lowered
    assert rows == {(None, "strasse"): 2, (3, "größere"): 3, (3, "grÖßere"): 1, (3, "letters" * 20000): 1}
    assert {r["word"]: r["n"] for r in spelling.count_words(found).collect()} == {"strasse": 2, "größere": 3}
    empty = spelling.variant_forms(spelling.count_words(spelling.runs(docs.limit(0))))
    assert empty.columns == COLUMNS and empty.count() == 0
    with pytest.raises(Exception, match="U\\+0000"):
        spelling.variant_forms(counted(spark, {"a\x00b": 1})).collect()


def test_without(spark):
    got = spark.createDataFrame([("größe", i) for i in range(5)], "w string, i int").select(spelling.without(F.col("w"), F.col("i"))).collect()
    assert [r[0] for r in got] == ["röße", "göße", "grße", "gröe", "größ"]


def test_query(spark, small_docs):
    counts = collections.Counter()
    for doc, text, _ in small_docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", ascii_lower(text)):
            h = zlib.crc32(f"{doc}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    # candidates by left-out characters instead of all pairs
    holes = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    assert forms_of(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == _by_holes(counts, holes)


def _by_holes(counts, holes):
    near = collections.defaultdict(set)
    for hole, words in holes.items():
        group = words | ({hole} if hole in counts else set())
        for w in group:
            near[w] |= {v for v in group if v != w and one_edit(w, v)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out
