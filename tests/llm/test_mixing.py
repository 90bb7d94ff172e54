import hashlib

from helpers import WORD, rows_of

from credence.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string"


def targets(sizes):
    """Water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def make(spark, n=6000):
    rows = []
    for i in range(n):
        source = "big" if i % 3 == 0 else [None, "", "a", "Z", "é", "tiny"][i % 6]
        if source == "tiny" and i > 60:
            source = "a"
        rows.append((i, source, " ".join(["w"] * (1 + i * 7919 % 97)), "clash"))
    rows += [(n, "none", None, ""), (n + 1, "none", "   ", "")]
    return rows, spark.createDataFrame(rows, SCHEMA).drop("size")


def test_targets_copies_and_words(spark):
    rows, docs = make(spark)
    got = {r["doc_id"]: r for r in rows_of(mixing.mix_plan(docs))}
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, s, t, _ in rows:
        r = got[i]
        assert r["size"] == len(WORD.findall(t or "")) and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 200
    again = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix_plan(docs.repartition(7)))}
    assert again == {i: r["copies"] for i, r in got.items()}


def test_mixed_rows_follow_the_plan(spark):
    rows, docs = make(spark, 300)
    docs = docs.withColumnRenamed("source", "source")
    plan = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix_plan(docs))}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in rows_of(out.groupBy("doc_id").count())}
    assert counts == {i: c for i, c in plan.items() if c}


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "a", "x y z")] * 3 + [(None, "b", "x"), (None, "b", "x"), (2, "b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == mixing.mix_plan(docs).selectExpr("sum(copies)").first()[0]
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_draws_are_independent_of_other_documents(spark):
    rows, docs = make(spark)
    one_rate = [(i, "a", t) for i, _, t, _ in rows] + [(-1, "b", "w " * 900_000)]
    docs = spark.createDataFrame(one_rate, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in rows_of(mixing.mix_plan(docs))}
    rate = got[0]["target"] / got[0]["source_size"]
    hashes = {}
    for i, _, t in one_rate:
        code = hashlib.md5(f"mix:{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        hashes[i] = int(code[:12], 16), int(code[12:24], 16)

    def copies(i, number):  # from the row's own id, text and rate
        r = got[i]["target"] / got[i]["source_size"]
        return int(r) + ((hashes[i][0] + number * hashes[i][1]) % 2**48 / 2**48 < r - int(r))

    for source in "ab":
        ids = [i for i, s, _ in one_rate if s == source]
        off = [abs(sum(got[i]["size"] * copies(i, n) for i in ids) - got[ids[0]]["target"]) for n in range(mixing.SEEDS)]
        assert all(got[i]["copies"] == copies(i, off.index(min(off))) for i in ids)
    extra = [got[i]["copies"] - int(rate) for i in range(6000)]
    f = rate - int(rate)
    assert 0.02 < f < 0.98
    blocks = [sum(extra[j : j + 60]) for j in range(0, 6000, 60)]  # 100 sums of 60 draws
    mean = sum(blocks) / 100
    spread = sum((b - mean) ** 2 for b in blocks) / 99
    assert 0.5 < spread / (60 * f * (1 - f)) < 1.7  # shared offsets would make it far smaller


def test_hot_null_ids_clashing_columns_and_long_text(spark):
    rows = [(None, "a", f"t{i} " * (1 + i % 9)) for i in range(2000)] + [(1, "b", "w " * 1_000_000), (2, None, None), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 AS copies", "'k' AS target", "source AS size")
    plan = rows_of(mixing.mix_plan(docs))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.filter("copies = 7 and target = 'k' and size <=> source").count() == sum(r["copies"] for r in plan)
    assert len({r["copies"] for r in plan if r["doc_id"] is None and r["size"]}) > 1 or plan[0]["target"] % plan[0]["source_size"] == 0


def test_no_python_and_no_window_over_documents(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "doc_id long, source string, text string")
    for frame in (mixing.mix_plan(docs), mixing.mix(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
