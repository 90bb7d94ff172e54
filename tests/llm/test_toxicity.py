import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import queries, toxicity

MID = "/root/testdata/sf0.01"
LEET = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}


@pytest.fixture(scope="module")
def costs(spark):
    return toxicity.language_model(toxicity.trigram_counts(spark.read.parquet(f"{MID}/documents.parquet")))


def plain_counts(texts):
    """Trigrams by a loop over characters."""
    out = np.zeros((64, 64, 64))
    table = toxicity.classes()
    s = [0, 0]
    for c in "\n".join(["", *texts, ""]):
        x = int(table[ord(c)])
        if x or s[-1]:
            s.append(x)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out[a, b, c] += 1
    return out


def test_counts_cover_every_text(spark):
    texts = ["Ab, c!", "", "  ", "éÉ ß x", "中 a" * 300, "a" * 2_500_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, *texts])], "doc_id long, text string, n int").repartition(3)
    got = toxicity.trigram_counts(df)
    one_by_one = sum(plain_counts([t]) for t in texts)
    inside = got.copy()
    # texts side by side only add the boundary between them
    assert (inside[1:, 1:, 1:] == one_by_one[1:, 1:, 1:]).all() and got.sum() >= sum(len(t) for t in texts[-1:])
    assert (toxicity.trigram_counts(df.limit(0)) == 0).all()


def test_language_model_is_a_distribution(costs):
    assert np.allclose(np.exp(-costs.astype(float)).sum(2), 1, atol=1e-4)


def readings(costs, span):
    """Every way through the lattice with its cost, by enumeration."""
    runs = [(s, len(list(g))) for s, g in itertools.groupby(c.lower()[0] for c in span)]
    lettered = [i for i, (s, _) in enumerate(runs) if s.isalpha()]
    signs = [s.isalpha() or s in toxicity.RESEMBLES for s, _ in runs]

    def piece(i, step):
        n = 0
        while 0 <= i < len(runs) and signs[i]:
            n, i = n + 1, i + step
        return n

    ways = [toxicity._ways(s, n, lettered[0] < i < lettered[-1], piece(i - 1, -1) < 2 and piece(i + 1, 1) < 2) for i, (s, n) in enumerate(runs)]
    for way in itertools.product(*ways):
        cost, text, a, b = 0.0, "", 0, 0
        for out, price in way:
            cost, text = cost + price, text + out
            for c in out:
                x = 0 if c == " " else int(toxicity.classes()[ord(c)])
                if x or b:
                    cost += float(costs[a, b, x])
                    a, b = b, x
        yield cost + (float(costs[a, b, 0]) if b else 0.0), " ".join(text.split())


@pytest.mark.parametrize("span", ["1d10t", "st.up.id", "i d i o t", "ssstuu", "l0$er", "a b", "p@7h3tic!", "é1éé", "9a9"])
def test_viterbi_finds_the_cheapest_reading(costs, span):
    want = min(readings(costs, span))
    got = toxicity.Decoder(costs).span(span)
    assert got == want[1] or any(abs(c - want[0]) < 1e-3 and t == got for c, t in readings(costs, span))


def test_doubled_letters_are_decided_one_by_one(costs):
    decoder = toxicity.Decoder(costs)
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(c * rng.choice([1, 1, 2]) for c, _ in itertools.groupby(rng.choice("abelnorstéß") for _ in range(rng.randint(1, 9))))
        assert decoder.doubled(word) == decoder.span(word), word


def test_restores_disguised_words(costs):
    decoder = toxicity.Decoder(costs)
    for word in ["stupid", "moron", "loser", "clown", "pathetic", "worthless", "trash"]:
        assert decoder.text(word) == decoder.text(word.upper() + "!!!") == decoder.text(f"{word}$$$") == word
    assert decoder.text("so m0r0n l0$er tr4sh p@thetic cl0wn") == "so moron loser trash pathetic clown"
    assert decoder.text("stuuuuupid mmmoronnnn s.t.u.p.i.d s-t-u-p-i-d st*pid") == "stupid moron stupid stupid stupid"
    assert decoder.text("that s t u p i d thing") == "that stupid thing"
    assert decoder.text("an ordinary, clean line.\n") == "an ordinary clean line"


def test_restored_texts(spark, costs):
    rows = [(1, "m0r0n", "x"), (None, None, "x"), (2, "", "y"), (2, "M O R O N " + "the " * 100_000, "y")]
    got = toxicity.restore(spark.createDataFrame(rows, "doc_id long, text string, restored string"), costs).collect()
    assert [(r["doc_id"], r["restored"]) for r in got[:3]] == [(1, "moron"), (None, None), (2, "")]
    assert got[3]["restored"].endswith(" the the") and got[3]["restored"].count("the") == 100_000 and got[3]["restored"].startswith("moron")


def test_memory_does_not_change_results(costs, monkeypatch):
    text = " ".join(f"w{i}0rd{i % 7}x" for i in range(300))
    want = toxicity.Decoder(costs).text(text), toxicity.Features(costs).of(text)
    monkeypatch.setattr(toxicity, "MEMORY", 2)
    assert (toxicity.Decoder(costs).text(text), toxicity.Features(costs).of(text)) == want


def disguise(rng, word):
    how = rng.randrange(3)
    if how == 0:
        return "".join(LEET.get(c, c) for c in word)
    if how == 1:
        return " ".join(word)
    i = rng.randrange(len(word))
    return word[:i] + word[i] * 4 + word[i:]


@pytest.fixture(scope="module")
def learned(spark):
    """Toxic words in a tenth of the texts; labels of a half; disguised words in texts never labelled."""
    rng = random.Random(1)
    bad = ["moron", "stupid", "pathetic", "worthless"]
    filler = [t for (t,) in spark.read.parquet(f"{MID}/documents.parquet").filter("lang = 'en'").select("text").collect() if not any(b in t for b in ("moron", "stupid", "pathetic", "worthless", "idiot", "loser", "scum", "trash", "clown", "disgusting"))]
    words = " ".join(filler).split()
    rows, labels, hidden = [], [], []
    for i in range(1500):
        w = rng.sample(words, 40)
        toxic = i % 10 == 0
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(30), b)
        rows.append((i, " ".join(w)))
        if i < 1000:
            labels.append((i, int(toxic)))
    for i in range(1500, 1560):
        w = rng.sample(words, 40)
        for b in bad:
            w.insert(rng.randrange(30), disguise(rng, b))
        rows.append((i, " ".join(w)))
        hidden.append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), hidden


def test_scores_disguised_texts(spark, learned):
    docs, labels, hidden = learned
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 1560 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] for i in hidden) >= 0.9 * len(hidden)
    clean = [i for i in range(1000, 1500) if i % 10]
    assert sum(got[i]["predicted"] for i in clean) <= 0.01 * len(clean)
    assert all(got[i]["predicted"] for i in range(1000, 1500, 10))


def test_sample_is_bounded_and_weighted(spark, learned):
    _, labels, _ = learned
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (0, 0), (1, 1)], "doc_id long, toxic int"))
    rows = toxicity.sample_labels(odd, "toxic", F.col("doc_id") % 2 == 1, per_class=50).collect()
    ids = {r["doc_id"]: r["label"] for r in rows}
    assert len(rows) == 51 and ids[1] == 1 and all(i % 2 for i in ids)  # of odd ids only 1 is toxic
    assert {r["label"]: r["weight"] for r in rows} == {0: 499 / 50, 1: 1.0}


def test_no_or_one_class(spark, learned):
    docs, labels, _ = learned
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {tuple(r) for r in toxicity.score(docs, toxicity.fit(docs, some)).select("score", "predicted").distinct().collect()} == {(0.0, 0)}
    empty = toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels))
    assert empty.columns == ["doc_id", "score", "predicted"] and empty.count() == 0


def test_query_holds_out_and_ignores_everything_but_text(spark, tmp_path):
    """Labels of held-out rows, ids' order, language and source do not change a score."""
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.op11_toxicity(spark, MID).collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held and len(got) == docs.count()
    flip = F.when(F.col("doc_id").isin(sorted(held)), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    labels.withColumn("toxic", flip.cast("int")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")).withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r["doc_id"]: r for r in queries.op11_toxicity(spark, str(tmp_path)).collect()}
    assert max(abs(got[i]["score"] - again[i]["score"]) for i in got) < 1e-6
    # held-out accuracy on English texts, whose toxic ones hold one of these words
    words = re.compile(r"\b(idiot|clown|loser|moron|trash|scum|pathetic|worthless|stupid|disgusting)\b", re.I)
    known = {r["doc_id"]: r["text"] for r in docs.filter("lang = 'en'").collect()}
    pairs = [(bool(words.search(known[i])), bool(got[i]["predicted"])) for i in held if i in known]
    assert sum(a and b for a, b in pairs) >= 0.9 * sum(a for a, _ in pairs) and sum(b and not a for a, b in pairs) <= 0.01 * len(pairs)
