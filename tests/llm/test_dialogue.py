import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from credence.llm import dialogue, queries

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GIVEN = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def brute(rows, costs=(0, 1, 2, 5, 5)):
    """rows: [(turn, role, text)] of one conversation; plain search from the end for (cost, edits)."""
    keep, rerole, delete, insert, cut = costs
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}

    def then(price, edit, rest, *line):
        return price + rest[0], edit + rest[1], line + rest[2]

    for i in range(len(rows), -1, -1):
        for inserts, q in itertools.product(range(4), GIVEN):
            ways = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
            to, name = GIVEN[q]
            if i < len(rows):
                _, role, text = rows[i]
                ways.append(then(delete, "D", best[i + 1, 3, q]))
                if faults[i] not in ("blank", "duplicate"):
                    extra = cut * (faults[i] == "truncated")
                    kind = role[:1]
                    if (kind, q) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                        ways.append(then(keep + extra, "K", best[i + 1, 3, kind], f"{role}:{text}"))
                    ways.append(then(rerole + extra, "R", best[i + 1, 3, to], f"{name}:{text}"))
            if inserts:
                ways.append(then(insert, "I", best[i, inserts - 1, to], f"{name}:"))
            best[i, inserts, q] = min(ways, default=(10**9, "", ()))
    cost, audit, lines = best[0, 3, ""]
    turns = [t for t, _, _ in rows if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def digests_of(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, convs=40, longest=14):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Upper", "usurper"]
    texts = ["Yes.", "No!", "cut", "a.\n", "  ", "", None, "why?", "x. y", " ", "é…", "end. "]
    turns = [None, -3, 0, 1, 2, 2, 3, 5, 9, 2**40]
    out = [(c, rng.choice(turns), rng.choice(roles), rng.choice(texts)) for c in [None, *range(convs)] for _ in range(rng.randint(1, longest))]
    rng.shuffle(out)
    return out


def grouped(rows):
    out = collections.defaultdict(list)
    for conv, *rest in rows:
        out[conv].append(tuple(rest))
    return out


@pytest.mark.parametrize("segment_rows", [1, 3, 2000])
def test_equals_plain_search(spark, segment_rows):
    rows = random_rows(segment_rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = digests_of(dialogue.digests(dialogue.repair(df, segment_rows=segment_rows)))
    assert got == {c: brute(r) for c, r in grouped(rows).items()}


@pytest.mark.parametrize("costs", [(0, 1, 2, 1, 5), (0, 3, 2, 1, 0), (1, 1, 2, 5, 5), (0, 1, 4, 2, 9)])
def test_other_costs_use_every_edit(spark, costs):
    rows = random_rows(str(costs), 25)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = digests_of(dialogue.digests(dialogue.repair(df, dialogue.Costs(*costs), segment_rows=2)))
    want = {c: brute(r, costs) for c, r in grouped(rows).items()}
    assert got == want
    assert set("".join(w[6] for w in want.values())) >= ({"D", "K", "I"} if costs[3] < 5 else {"D", "K"})


def test_blocks_equal_single_steps():
    table, single = dialogue.tables(dialogue.Costs()), dialogue.tables(dialogue.Costs(), 1)
    rng = random.Random(5)
    for n in (0, 1, 3, 4, 5, 8, 41):
        symbols = dialogue.np.array([rng.randrange(dialogue.SYMBOLS) for _ in range(n)], dialogue.np.int64)
        assert table.trace(symbols) == single.trace(symbols)
        before, states = table.summary(symbols)
        assert before.tolist() == single.summary(symbols)[0].tolist()
        for v in range(len(table.vectors)):
            for q in range(4):
                assert table.trace(symbols, v, q, last=False)[1] == states[v, q]


def test_long_conversation_is_cut_over_tasks(spark):
    """A third of all rows in one conversation, most of them one row repeated."""
    rows = [(7, i % 5, "user", "same text.") for i in range(3000)] + [(7, 10 + i, ["user", "assistant"][i % 2], f"part {i}." if i % 7 else "cut") for i in range(3000)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(100, 4100) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = dialogue.repair(df, segment_rows=100).cache()
        pieces.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of_one = pieces.filter("conv_id = 7")
    assert of_one.count() >= 60 and of_one.select("part").distinct().count() > 1
    got = digests_of(dialogue.digests(pieces))
    assert got == {c: brute(r) for c, r in grouped(rows).items()}
    # the pieces hold the repaired rows themselves
    lines = [f"{x['role']}:{x['text']}" for r in of_one.orderBy("part", "seq").collect() for x in r["repaired"]]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[7][-1]


def test_odd_tables(spark):
    schema = "turn long, conv_id string, text string, role string, kind string, digest string"
    rows = [(0, "a", "x" * 3_000_000 + ".", "user", "k", "d"), (1, "a", "y" * 2_000_000 + "!", "assistant", "k", "d"), (0, "b", "hi.", "user", None, None), (0, "c", "hi.", "user", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = digests_of(dialogue.digests(dialogue.repair(df, present=F.col("conv_id") != "c")))
    want = {c: brute([(t, r, x) for t, cc, x, r, *_ in rows if cc == c]) for c in "ab"} | {"c": (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got == want
    empty = dialogue.digests(dialogue.repair(df.limit(0)))
    assert empty.columns == ["conv_id", *COLUMNS] and empty.count() == 0


def test_query_on_odd_rows(spark, tmp_path):
    rows = random_rows(99, 60)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = digests_of(queries.op12_dialogue_repair(spark, str(tmp_path)))
    assert got == {c: brute(r) for c, r in damage(rows).items()}
