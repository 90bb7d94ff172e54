import hashlib

from helpers import ascii_lower, rows_of

from credence.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, note string"


def test_groups_keep_largest_id_and_pass_columns(spark):
    rows = [(1, "Same", "x", "a"), (7, "sAME", "y", "b"), (3, "same", None, "c"), (4, "ÉTÉ", "z", "d"), (5, "été", "z", "e"),
            (8, None, "n", "f"), (9, "", "n", "g"), (10, "x" * 500_000, "l", "h")]
    got = {r["doc_id"]: r for r in rows_of(exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)))}
    assert {k: (r["keep_id"], r["group_size"], r["kept"], r["note"]) for k, r in got.items()} == {
        1: (7, 3, False, "a"), 7: (7, 3, True, "b"), 3: (7, 3, False, "c"), 4: (4, 1, True, "d"), 5: (5, 1, True, "e"),
        8: (9, 2, False, "f"), 9: (9, 2, True, "g"), 10: (10, 1, True, "h")}
    for i, text, _, _ in rows:
        assert got[i]["text_sha256"] == hashlib.sha256(ascii_lower(text).encode()).hexdigest()


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a", "", ""), (5, "a", "", ""), (None, "a", "", ""), (None, "b", "", "")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows_of(exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)))), key=str)
    assert got == sorted([(5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (None, None, 1, True)], key=str)
    empty = exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and set(empty.columns) == {"doc_id", "text", "note", "keep_id", "group_size", "kept", "text_sha256"}


def test_full_filter_and_hot_group_lose_nothing(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide, narrow = (rows_of(exact_dedup.exact_dedup(docs, max_bits=b).select("doc_id", "keep_id", "group_size", "kept")) for b in (1 << 28, exact_dedup.PAGE_BITS))
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(t, []).append(i)
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t, _, _ in rows)
    for got in (wide, narrow):
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "", "")], SCHEMA)
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
