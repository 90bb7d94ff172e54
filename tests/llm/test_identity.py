"""Different words, windows and vectors are told apart, also where simple hashes agree."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL, jaccard_components, rows_of, tokenizer_path, without_repeats  # noqa: F401
from tokenizers import Tokenizer

from credence.llm import _encode, _text, ngram_join, packing, quality, queries, substring_dedup, token_files, vector_dedup
from credence.llm._scratch import folder

DOC = "doc_id long, text string"


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2**64 agree for every odd multiplier."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [thue_morse(1024), thue_morse(4096)]


@pytest.mark.parametrize("seed", [0, 1])
def test_word_hashes(seed):
    ws = sorted({w for pair in PAIRS for w in pair} | {"x" * n for n in range(1, 200)} | {f"w{i}" for i in range(50_000)} | {"a\x00", "a", "\x00"})
    data, offsets = _text.utf8(pa.array([" ".join(ws)]))
    starts, ends, _ = _text.words(data, offsets)
    got = _text.word_hashes(data, starts, ends, seed=seed)
    assert len(np.unique(got)) == len(ws)
    assert len(np.intersect1d(got, _text.word_hashes(data, starts, ends, seed=1 - seed))) == 0
    # a word's hash does not depend on its place
    moved = _text.utf8(pa.array(["é " + " ".join(reversed(ws))]))
    starts, ends, _ = _text.words(*moved)
    assert (_text.word_hashes(moved[0], starts, ends, seed=seed)[1:][::-1] == got).all()
    upper = _text.utf8(pa.array([" ".join(ws).upper()]))
    starts, ends, _ = _text.words(*upper)
    assert (_text.word_hashes(upper[0], starts, ends, fold=True, seed=seed) == got).all()


@pytest.mark.parametrize("hot_rows", [substring_dedup.HOT_ROWS, 1])
def test_windows(spark, hot_rows):
    common = " ".join(f"c{i}" for i in range(60))
    docs = {2 * i + j: f"{common} {w} {common}"[: None if j else 10**6] for i, pair in enumerate(PAIRS) for j, w in enumerate(pair)}
    docs |= {10 + i: f"{w} " + " ".join(f"d{k}" for k in range(49)) for i, pair in enumerate(PAIRS) for w in [pair[0]]}
    docs |= {20 + i: f"{w} " + " ".join(f"d{k}" for k in range(49)) for i, pair in enumerate(PAIRS) for w in [pair[1]]}
    want = {d: (n, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, (n, kept) in without_repeats(docs, 50).items()}
    got = substring_dedup.remove_repeats(spark.createDataFrame(sorted(docs.items()), DOC), hot_rows=hot_rows)
    assert {r["doc_id"]: (r["n_words"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows_of(got)} == want


def test_shingle_sets(spark):
    docs = {i: " ".join([w] * 5) for i, w in enumerate(w for pair in PAIRS for w in pair)}
    docs |= {10 + i: t for i, t in docs.items()}
    sizes, want = jaccard_components(docs, 4, 85)
    got = rows_of(ngram_join.similar_components(spark.createDataFrame(sorted(docs.items()), DOC)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (sizes[d], want[d]) for d in docs}


def test_token_ids(spark, tokenizer_path):
    lib = Tokenizer.from_file(tokenizer_path)
    texts = [w for pair in PAIRS for w in pair] + ["and " + PAIRS[0][1], " ".join(PAIRS[1])]
    enc = _encode.Encoder(tokenizer_path)
    for batch in (texts, texts[::-1]):
        ids, first = enc.encode(*_text.utf8(pa.array(batch)))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in batch]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    path = folder(spark, "identity")
    token_files.write_token_files(docs, path, tokenizer_path)
    want = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["ids"]) for r in rows_of(token_files.read_token_files(spark, path))} == want
    pieces = sorted(rows_of(packing.pack(docs, tokenizer_path)), key=lambda r: (r["doc_id"], r["start"]))
    assert {i: b"".join(bytes(r["ids"]) for r in pieces if r["doc_id"] == i) for i in want} == want


def test_one_hash_of_two_words(tokenizer_path, monkeypatch):
    """When all first hashes agree, the second ones do not, and the texts are encoded whole."""
    plain = _text.word_hashes
    monkeypatch.setattr(_text, "word_hashes", lambda *a, seed=0, **k: plain(*a, seed=seed, **k) * np.uint64(seed))
    lib, enc = Tokenizer.from_file(tokenizer_path), _encode.Encoder(tokenizer_path)
    for text in ("one two", "one", "three"):
        assert enc.encode(*_text.utf8(pa.array([text])))[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_metadata_codes_take_whole_values():
    names = [f"{x}/common-ending" for x in ("a", "b", "c", "d")]
    assert len(set(quality.meta_codes(names, names, np.zeros(4))[1].tolist())) > 1
    lang, _, _ = quality.meta_codes([None, "", "x"], ["", "", ""], np.zeros(3))
    assert lang[0] == 0 and lang[1] > 0 and lang.max() < quality.META_SLOTS


def brute_links(rows, threshold=0.93):
    """(id, links of the row, component) of (id, vector, label) rows, each row a vector."""
    unit = [None if r[2] is None or r[0] is None else np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows]
    linked = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and float(unit[i] @ unit[j]) >= threshold] for i in range(len(rows))]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, js in enumerate(linked):
        for j in js:
            a, b = sorted((find(rows[i][0]), find(rows[j][0])))
            root[b] = a
    return sorted((r[0], len(js), find(r[0])) for r, js in zip(rows, linked, strict=True))


def test_links_of_unlike_vectors_with_one_id(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near_y = [0.02, 1.0, 0.0]
    rows = [(5, x, 1), (5, y, 1), (7, x, 1), (8, near_y, 1), (9, near_y, 1), (5, x, 2), (6, x, 2), (4, y, 2), (5, y, 3)]
    got = rows_of(vector_dedup.link_counts(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)


def test_links_query(spark):
    """The registered query on the whole table, with some ids given to other rows as well."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = rows_of(queries.op1_embedding_near_dedup(spark, SMALL))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)
    rng = random.Random(2)
    rows = [(rng.randrange(60), v, label) for _, v, label in rows]
    got = rows_of(vector_dedup.link_counts(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)
