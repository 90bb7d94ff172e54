import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL, rows_of, small_docs, tokenizer_path  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credence.llm import _encode, _text, packing, queries, token_counts, token_files
from credence.llm._scratch import folder

ODD = ["", None, "   ", "<|endoftext|>x a<|startoftext|> b", "çá é can't 'S 12% ", " x y", "İ ß Σας ΣΑΣ", "a\x00b", "é ñ", "中文 text", "!!! ... a-b_c"]


@pytest.fixture(scope="module")
def lib(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_whole_text_encoding(name, small_docs):
    import public_tokenizers

    path = public_tokenizers.path(name)
    lib, texts = Tokenizer.from_file(path), ODD + [t for _, t, _ in small_docs[:60]]
    enc = _encode.Encoder(path, offsets=True)
    assert enc.by_word == (name == "word_bpe_49k.json")
    data, offsets = _text.utf8(pa.array(texts))
    ids, first, spans = enc.encode_spans(data, offsets)
    base = _encode.char_index(data)[offsets]
    for i, text in enumerate(texts):
        want = lib.encode(text or "", add_special_tokens=False)
        assert ids[first[i] : first[i + 1]].tolist() == want.ids
        assert [tuple(s) for s in (spans[first[i] : first[i + 1]] - base[i]).tolist()] == want.offsets


def test_encoder_table_is_emptied_without_changing_results(lib, tokenizer_path, monkeypatch):
    monkeypatch.setattr(_encode, "MAX_WORDS", 3)
    enc = _encode.Encoder(tokenizer_path)
    for text in ["one two three four", "five six one two", "seven"] * 2:
        ids, _ = enc.encode(*_text.utf8(pa.array([text])))
        assert ids.tolist() == ids_of(lib, text)


def check_files(lib, rows, got):
    at = 0
    got = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["start"]))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got, strict=True):
        want = np.array([*ids_of(lib, text), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, at, len(want)) and bytes(r["ids"]) == want.tobytes()
        at += len(want)


def test_token_files_round_trip(spark, lib, tokenizer_path):
    rows = [(100 - i, t) for i, t in enumerate(ODD)] + [(3, "same id b"), (3, "same id a"), (None, "no id"), (200, "long text " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    path = folder(spark, "test-files")
    manifest = token_files.write_token_files(docs, path, tokenizer_path, parts=3)
    assert [r["width"] for r in rows_of(manifest)] == [2] * manifest.count()
    check_files(lib, rows, rows_of(token_files.read_token_files(spark, path)))


def test_token_files_of_an_empty_table(spark, tokenizer_path):
    path = folder(spark, "test-files")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_op8_matches_brute_force(spark, lib, small_docs):
    got = {r["doc_id"]: r for r in rows_of(queries.op8_token_files(spark, SMALL))}
    at = 0
    for doc, text, _ in small_docs:
        want = np.array([*ids_of(lib, text), 1], "<u4")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def check_packing(pieces, docs_ids, capacity=2048):
    """Each id in one piece, no gaps; returns (padding, ids)."""
    by_doc, by_bin = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs_ids)
    for doc, parts in by_doc.items():
        body = b"".join(bytes(p["ids"]) for p in sorted(parts, key=lambda p: p["start"]))
        assert body == np.array(docs_ids[doc], "<u4").tobytes()
        assert all(p["doc_tokens"] == len(docs_ids[doc]) for p in parts)
    padding = total = 0
    assert set(by_bin) == set(range(len(by_bin)))
    for parts in by_bin.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, total


def test_packing(spark, lib, tokenizer_path, small_docs):
    rows = [(d, t) for d, t, _ in small_docs] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "long text " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    padding, total = check_packing(rows_of(packing.pack(docs, tokenizer_path)), {d: [*ids_of(lib, t), 1] for d, t in rows})
    assert padding <= 0.001 * total
    small = packing.pack(docs, tokenizer_path, capacity=256, min_piece=32)
    check_packing(rows_of(small), {d: [*ids_of(lib, t), 1] for d, t in rows}, 256)


def test_packing_full_tail_bins(spark, lib, tokenizer_path):
    rows = [(i, "a b") for i in range(1500)] + [(i, "a b c d e f") for i in range(1500, 2200)]  # tails of 3 and 7 ids
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    padding, _ = check_packing(rows_of(packing.pack(docs, tokenizer_path)), {d: [*ids_of(lib, t), 1] for d, t in rows})
    assert padding == 2 * (2048 - 682 * 3) + 2 * (2048 - 292 * 7)


def test_packing_repeated_ids_null_ids_empty_table(spark, tokenizer_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = rows_of(packing.pack(docs, tokenizer_path))
    assert len(got) == 3 and sorted((r["offset"], r["length"]) for r in got) == [(0, 2), (0, 2), (2, 2)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path).count() == 0


SECTIONS = "doc_id long, text string, sections array<struct<name string, start int, end int>>"


def brute_sections(lib, text, sections):
    spans, reach = [], 0
    for name, s, e in sorted(sections or [], key=lambda x: x[1] or 0):
        s, e = (min(max(x or 0, 0), len(text or "")) for x in (s, e))
        s = max(s, reach)
        reach = max(reach, e)
        spans.append((name, s, max(s, e)))
    out = {}
    for name, _, _ in spans:
        out.setdefault(name, [0, 0])
    for a, b in lib.encode(text or "", add_special_tokens=False).offsets:
        hits = [(min(e, b) - max(s, a), -i) for i, (_, s, e) in enumerate(spans) if s < e and s < b and e > a]
        name = spans[-max(hits)[1]][0] if hits else token_counts.OUTSIDE
        cell = out.setdefault(name, [0, 0])
        cell[0] += 1
        cell[1] += len(hits) > 1
    return out


def test_section_tokens_against_brute_force(spark, lib, tokenizer_path, small_docs):
    rng = np.random.default_rng(5)
    rows = [(i, t, None if i == 3 else []) for i, t in enumerate(ODD)]
    for d, t, _ in small_docs[:60]:
        cuts = np.sort(rng.integers(0, len(t) + 1, 8)).tolist()
        rows.append((1000 + d, t, [("a", 0, cuts[0]), ("b", cuts[0], cuts[1]), ("a", cuts[1], cuts[2]), ("c", cuts[3], cuts[5]), ("d", cuts[4], cuts[7]), ("e", 7, 7), ("f", -5, 2), ("g", None, 3), ("h", 9, 10**9)]))
    got = {}
    for r in rows_of(token_counts.section_tokens(spark.createDataFrame(rows, SECTIONS), tokenizer_path)):
        got.setdefault(r["doc_id"], {})[r["section"]] = [r["n_tokens"], r["n_crossing"]]
    crossing = 0
    for i, t, s in rows:
        want = brute_sections(lib, t, s)
        assert got.get(i, {}) == want, i
        crossing += sum(c for _, c in want.values())
    assert crossing > 50


def test_op4_counts_every_token_once(spark, lib, small_docs):
    import duckdb

    got = {}
    for r in rows_of(queries.op4_token_counts(spark, SMALL)):
        got.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
    for doc, text, source, lang in duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SMALL}/documents.parquet'").fetchall():
        head = text.split("\n", 1)[0]
        at = len(source) + len(lang) + 2
        want = brute_sections(lib, f"{source}:{lang}:{text}", [("source", 0, len(source)), ("lang", len(source) + 1, at - 1), ("first_line", at, at + len(head)), ("body", at + len(head), at + len(text))])
        assert got[doc] == {k: v[0] for k, v in want.items()}
