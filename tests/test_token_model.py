"""Tokens of a text are counted inside its row."""

from credence.operators import token_model


def test_tokens_are_counted_without_a_shuffle(spark):
    rows = [(1, "A b a, A!"), (2, None), (3, ""), (4, " ".join(f"w{i % 7}" for i in range(700)))]
    out = token_model.tokens(spark.createDataFrame(rows, "pos long, text string"), "pos")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.pos, r.token): r.n for r in out.collect()}
    assert got == {(1, "a"): 3, (1, "b"): 1} | {(4, f"w{i}"): 100 for i in range(7)}
