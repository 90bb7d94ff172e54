import hashlib
import random

import numpy as np
import pytest
from helpers import SMALL, jaccard_components, rows_of, small_docs, smallest_reachable, without_repeats  # noqa: F401
from pyspark.sql import functions as F

from credence.llm import ngram_join, queries, substring_dedup, vector_dedup
from credence.llm.components import components

DOC = "doc_id long, text string"


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 400)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = smallest_reachable(nodes, [p for p in links if p[0] != p[1]])
    for chunk in (10_000, 60):  # one task, and rounds over several
        found = components(spark.createDataFrame(links, "u long, v long"), chunk_edges=chunk)
        assert {r["node"]: r["component"] for r in rows_of(found)} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_texts(seed=1):
    """Families of near copies at many distances, shared passages, short, empty and repeated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = {}
    for f in range(12):
        base = [word() for _ in range(rng.choice([5, 12, 40, 120, 300]))]
        if f % 3 == 0:
            base += passage
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            docs[len(docs)] = " ".join(copy)
    docs |= {len(docs) + i: t for i, t in enumerate([None, "", " \t", "one", "ONE", "one two", "one  two", "one two three", "a b c d", "A B C D", "É b c d", "é b c d", "x " * 20_000])}
    return docs


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 100)])
def test_jaccard_components(spark, k, percent):
    docs = near_texts(k)
    frame = spark.createDataFrame(list(docs.items()), DOC).withColumn("n", F.lit("clash"))
    sizes, want = jaccard_components(docs, k, percent)
    got = {r["doc_id"]: r for r in rows_of(ngram_join.similar_components(frame, k, percent))}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (sizes[d], want[d]) for d in docs}


def test_jaccard_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(ngram_join, "EDGE_STEP", 7)
    docs = near_texts(9)
    _, want = jaccard_components(docs, 4, 85)
    got = ngram_join.similar_components(spark.createDataFrame(list(docs.items()), DOC))
    assert {r["doc_id"]: r["component_id"] for r in rows_of(got)} == want


def test_jaccard_repeated_and_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (6, "q r s t"), (7, "q r s t u"), (6, "z z z z z z")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.similar_components(spark.createDataFrame(rows, DOC)))), key=str)
    assert got == sorted([(5, 2, 4), (5, 2, 4), (4, 2, 4), (None, 2, None), (6, 1, 6), (7, 2, 7), (6, 1, 6)], key=str)
    assert ngram_join.similar_components(spark.createDataFrame([], DOC)).count() == 0


def test_op10_matches_brute_force(spark, small_docs):
    sizes, want = jaccard_components({d: t for d, t, _ in small_docs}, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(queries.op10_ngram_join(spark, SMALL))}
    assert got == {d: (sizes[d], want[d]) for d, _, _ in small_docs}


def repeat_texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (20, 50, 51, 90, 200)]
    docs = {0: None, 1: "", 2: " ".join(passages[4] * 2)}
    for i in range(3, 120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 10)
            parts += [word() for _ in range(rng.randrange(0, 40))] + (p if rng.random() < 0.5 else p[a:])
        docs[i] = "  ".join(parts[:1]) + " " + "\n".join(parts[1:])
    docs[120] = docs[7]
    docs[121] = "same " * 300
    docs[122] = "same " * 80
    return docs


@pytest.mark.parametrize("hot_rows", [substring_dedup.HOT_ROWS, 4])
def test_repeats_are_removed(spark, hot_rows):
    docs = repeat_texts()
    frame = spark.createDataFrame(list(docs.items()), DOC).selectExpr("*", "'x' AS id", "'y' AS start", "1 AS n_words").repartition(6)
    want = without_repeats(docs, 50)
    got = rows_of(substring_dedup.remove_repeats(frame, hot_rows=hot_rows))
    assert {r["doc_id"]: (r["n_words"], r["n_words"] - r["n_removed"], r["kept_text"], r["id"], r["start"]) for r in got} == {
        d: (n, len(kept), " ".join(kept), "x", "y") for d, (n, kept) in want.items()}


def test_factors_name_the_earliest_source(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:60])), (2, " ".join(words[30:140])), (3, " ".join(words))]
    got = sorted((r["id"], r["start"], r["end"], r["source"]) for r in rows_of(substring_dedup.factors(spark.createDataFrame(rows, DOC))))
    covered = {s: set() for s in (1, 2)}
    for doc, start, end, source in got:
        assert doc == 3
        covered[source].update(range(start, end))
    assert covered == {1: set(range(60)), 2: set(range(30, 140))}


def test_repeats_null_ids_repeated_rows_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (6, text), (5, text + " more")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in rows_of(substring_dedup.remove_repeats(spark.createDataFrame(rows, DOC)))), key=str)
    assert got == sorted([(5, 60, 0), (5, 60, 0), (None, 60, 0), (6, 60, 60), (5, 61, 0)], key=str)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def test_op2_matches_brute_force(spark, small_docs):
    want = without_repeats({d: t for d, t, _ in small_docs}, 50)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(queries.op2_substring_dedup(spark, SMALL))}
    assert got == {d: (n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, (n, k) in want.items()}


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = {i: 0 for i, _, _ in rows}, []
    for a, (i, v, lab) in enumerate(good):
        for j, w, other in good[:a]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    return n, smallest_reachable(n, links)


def vectors(dim, families, size, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = rng.standard_normal(dim)
        for _ in range(size):
            noise = rng.standard_normal(dim) * rng.choice([0.1, 0.25, 0.35, 0.5])
            rows.append((len(rows), [float(np.float32(x)) for x in base + noise], int(f % 3)))
    rows.append((len(rows), rows[0][1], rows[0][2]))  # an exact copy, and one with another label
    rows.append((len(rows), rows[0][1], 9))
    return rows


@pytest.mark.parametrize("dim", [64, 32, 3])
def test_vector_links(spark, monkeypatch, dim):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 40)  # also block pairs
    monkeypatch.setattr(vector_dedup, "PAIR_ROWS", 16)  # and matrix products
    rows = vectors(dim, 40, 12)
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, rows[5][1], None), (n + 5, [float("inf")] * dim, 1), (n + 6, [1.0] * (dim + 1), 1), (n + 7, [], 1)]
    links, want = brute_links(rows, 0.93)
    got = {r["vec_id"]: r for r in rows_of(vector_dedup.link_counts(spark.createDataFrame(rows, VECTORS)))}
    assert len(got) == len(rows)
    found, true = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in links) and found >= 0.99 * true > 0
    if found == true:
        assert {i: (r["component_id"], r["kept"]) for i, r in got.items()} == {i: (c, c == i) for i, c in want.items()}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    for words in (64, 256, 1024):
        u = rng.standard_normal((600, 64))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w = rng.standard_normal((600, 64))
        w -= (w * u).sum(1)[:, None] * u
        w /= np.linalg.norm(w, axis=1)[:, None]
        code = vector_dedup.Code(64, words)
        a, b = (code.decode(x)[1].reshape(600, -1) for x in (u, 0.93 * u + np.sqrt(1 - 0.93**2) * w))
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.97


def test_list_decoding_is_complete():
    rng = np.random.default_rng(6)
    unit = rng.standard_normal((50, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    code = vector_dedup.Code(16, 64)
    x = unit @ code.turn
    scores = (x[:, :8] @ code.words[0].T)[:, :, None] + (x[:, 8:] @ code.words[1].T)[:, None, :]
    best = np.argsort(-scores.reshape(50, -1), axis=1)[:, : code.filters]
    assert (np.sort(best, 1) == code.decode(unit)[1].reshape(50, -1)).all()


def test_vectors_repeated_ids_empty_table(spark):
    rows = [(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(vector_dedup.link_counts(spark.createDataFrame(rows, VECTORS)))), key=str)
    assert got == sorted([(3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (None, 0, None, False), (9, 0, 9, True)], key=str)
    assert vector_dedup.link_counts(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("hot_rows", [substring_dedup.HOT_ROWS, 1])
def test_windows_are_told_apart_by_their_whole_hashes(spark, hot_rows):
    """49 common words are below the window. The hashes of the two windows in each pair are equal in
    their low 40 bits; the third text repeats the first."""
    common = " ".join(f"c{i}" for i in range(49))
    for a, b in ((2112757, 3794778), (1694179, 2081677), (1119288, 3823921)):
        rows = [(1, f"{common} w{a}"), (2, f"{common} w{b}"), (3, f"{common} w{a}")]
        got = {r["doc_id"]: r["n_removed"] for r in rows_of(substring_dedup.remove_repeats(spark.createDataFrame(rows, DOC), hot_rows=hot_rows))}
        assert got == {1: 0, 2: 0, 3: 50}
