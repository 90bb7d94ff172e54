"""Toxicity of texts that a noisy-channel decoder restores first.

1. Language model. Characters fall into 64 classes (a word boundary, a-z, the Latin-1 letters, other
   letters). Their trigrams are counted over every text of the corpus, in the tasks, and summed; the
   table has at most 64**3 entries whatever the corpus. Smoothed, it gives P(character | two before).
2. Channel. An obfuscated span becomes a lattice: a digit or mark stands for itself (a boundary) or for
   the letters it resembles, a repeated letter for one or two, a separator or space between letters for
   a boundary or for nothing, an asterisk also for any letter. Each way has a cost. Viterbi search over
   the last two characters finds the text of least cost under channel and language model. Spans are
   words that hold such signs or doubled letters, and runs of at least three single characters.
   A separator costs less to drop than to keep between single characters, more between longer pieces.
3. Score. The restored words and their beginnings (4 to 8 letters, of longer words) are hashed to ``BINS``. Bins whose
   document rates differ most between toxic and clean labels (at most ``CHOSEN``, standardised
   difference over ``MIN_Z``, in at least 5 documents) enter a logistic regression that Spark fits;
   every text is scored by the bins it has. Rows are weighted back to the labels' true frequency.

Bounds: the classifier is fitted on at most ``PER_CLASS`` labelled documents of each class, the first
in the order of their ids' md5, so that the sample's ids can be broadcast and no text is shuffled. The
language model and the scores cover all rows and whole texts. Restored words are remembered per Python
worker, at most ``MEMORY`` of each kind, which changes no result.

Defined cases
-------------
* null or empty text: no words, the score of a text without any chosen bin. Null id: scored, never
  learned from. Null label, or label row with a null id: not learned from. Two labels for one id: the
  larger counts. Repeated rows and ids: each row on its own.
* labels of one class only, or none: score 0 for all. Empty table: empty result.
* very long words are decoded whole (time grows with their length), extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm import _text
from credence.llm._scratch import materialize

PER_CLASS = 20_000
BINS = 1 << 18
BEGINNINGS = (4, 5, 6, 7, 8)
CHOSEN = 400
MIN_Z = 5.5
MEMORY = 200_000
#: Smoothing: the weight of the lower order.
BACKOFF = 5.0
#: Costs (negative logarithms) of the channel's ways.
LEET, REPEATED, DOUBLED, BREAK, ANY = 1.5, 0.5, 6.0, 8.0, 5.0
#: Dropping and keeping a separator: between single characters, and otherwise.
SPELLED, PARTED = (0.5, 2.0), (2.5, 0.5)
#: Letters that a digit or mark resembles.
RESEMBLES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 64
_OTHER = 60  # letters outside Latin-1

_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in RESEMBLES)
_WORD = re.compile(r"[^\W\d_]+")
#: Letters without a doubled one, amid punctuation that cannot be a letter: nothing to decode.
_PLAIN = re.compile(r"(?![^\w\s]*(?:\S*?([^\W\d_])\1))[^\w$@]*[^\W\d_]+(?:[^\w$@]*|[^\w]{3,})\Z")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_DOUBLED_ONLY = re.compile(r"(?!.*([^\W\d_])\1\1)[^\W\d_]+\Z")
#: Single characters, each between white space.
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){2,}")


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
            table[code] = _OTHER
    for i, c in enumerate(_LETTERS):
        table[ord(c)] = table[ord(c.upper())] = 1 + i
    for code in range(0xDF, 0x100):  # ß, à to ÿ; À to Þ count as the same letters
        if table[code]:
            table[code] = 27 + code - 0xDF
            if code > 0xDF and table[code - 32]:
                table[code - 32] = table[code]
    return table


_tables: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point; built once per process."""
    if not _tables:
        _tables.append(_classes())
    return _tables[0]


def _symbols(texts: list[str]) -> np.ndarray:
    """Classes of the texts, two boundaries between them, runs of boundaries as one otherwise."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    s = classes()[codes]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep].astype(np.int64)
    return np.concatenate([[0], s])


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each character follows two others over all of ``text``, as a (64, 64, 64) array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for batch in _text.chunks(batches):
            s = _symbols(batch.column(0).fill_null("").to_pylist())
            total += np.bincount((s[:-2] * _N + s[1:-1]) * _N + s[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_N**3, np.float64)  # at most 64**3 rows
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(_N, _N, _N)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -log P(c | a, b) from trigram counts, each order smoothed by the one below."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + _N)
    two = counts.sum(0)
    two = (two + BACKOFF * one) / (two.sum(1, keepdims=True) + BACKOFF)
    three = (counts + BACKOFF * two) / (counts.sum(2, keepdims=True) + BACKOFF)
    return -np.log(three).astype(np.float32)


def _ways(sign: str, run: int, inner: bool, spelled: bool) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with its cost; a blank is a word boundary. ``inner``: letters
    stand on both sides; ``spelled``: single characters do."""
    if sign.isalpha():
        if run == 1:
            return [(sign, 0.0)]
        return [(sign * 2, 0.0), (sign, DOUBLED)] if run == 2 else [(sign, REPEATED), (sign * 2, REPEATED)]
    out: list[tuple[str, float]] = []
    for letter in RESEMBLES.get(sign, ""):
        out += [(letter, LEET)] if run == 1 else [(letter, LEET + REPEATED), (letter * 2, LEET + REPEATED)]
    if out:
        return [*out, (" ", BREAK if inner or (run < 3 and sign not in "!|+(") else 0.0)]
    if not inner:
        return [(" ", 0.0)]
    drop, keep = SPELLED if spelled else PARTED
    out = [("", drop), (" ", keep)]
    if sign == "*" and run == 1:
        out += [(letter, ANY) for letter in _LETTERS]
    return out


def bare(token: str) -> str:
    """The token in lower case without the signs around it that can only be boundaries."""
    return token.strip(_EDGE).lower()


class Decoder:
    """Least-cost reading of spans under a language model (costs as of ``language_model``)."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}

    def span(self, span: str) -> str:
        """The restored span, lower case, words apart by one blank."""
        table, costs = classes(), self.costs
        runs = [(sign, len(list(g))) for sign, g in groupby(c.lower()[0] for c in span)]
        lettered = [i for i, (sign, _) in enumerate(runs) if sign.isalpha()]
        if not lettered:
            return ""
        content = [sign.isalpha() or sign in RESEMBLES for sign, _ in runs]
        pieces = [0] * (len(runs) + 2)  # content signs since the last separator, then up to the next
        for i, c in enumerate(content):
            pieces[i + 1] = pieces[i] + 1 if c else 0
        for i in range(len(runs) - 1, -1, -1):
            if content[i] and i + 1 < len(runs) and content[i + 1]:
                pieces[i + 1] = pieces[i + 2]
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for i, (sign, run) in enumerate(runs):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for out, price in _ways(sign, run, lettered[0] < i < lettered[-1], pieces[i] < 2 and pieces[i + 2] < 2):
                codes = [0 if c == " " else int(table[ord(c)]) for c in out]
                for (a, b), (cost, text) in best.items():
                    cost += price
                    for c in codes:
                        if c or b:
                            cost += costs[a][b][c]
                            a, b = b, c
                    found = after.get((a, b))
                    if found is None or (cost, text + out) < found:
                        after[a, b] = (cost, text + out)
            best = after
        ends = [(cost + (costs[a][b][0] if b else 0.0), text) for (a, b), (cost, text) in best.items()]
        return " ".join(min(ends)[1].split())

    def doubled(self, word: str) -> str:
        """A word whose only signs are letters, at most doubled: what is before a doubled letter and
        what follows is the same with one of it, so each is decided for itself."""
        table, costs = classes(), self.costs

        def choose(m: re.Match) -> str:
            at, end = m.span()
            b, c, d = (int(table[ord(x)]) if x else 0 for x in (word[at - 1 : at], word[at], word[end : end + 1]))
            return m.group(1) if costs[b][c][c] + costs[c][c][d] > costs[b][c][d] + DOUBLED else m.group()

        return _DOUBLE.sub(choose, word)

    def word(self, token: str) -> str:
        """The restored words of one token without white space, as of ``bare``."""
        if _PLAIN.match(token):
            return " ".join(_WORD.findall(token.lower()))
        found = self.known.get(token)
        if found is None:
            found = self.doubled(token) if _DOUBLED_ONLY.match(token) else self.span(token)
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[token] = found
        return found

    def text(self, text: str) -> str:
        """The restored text: words in lower case, one blank apart."""
        joined = _SPACED.sub(lambda m: self.span(m.group()), text)
        return " ".join(filter(None, map(self.word, map(bare, joined.split()))))


def _bins(word: str) -> set[int]:
    """Hashed bins of a restored word and its beginnings."""
    keys = {"=" + word} | {word[:n] for n in BEGINNINGS if len(word) > n}
    return {zlib.crc32(k.encode("utf-8", "replace")) % BINS for k in keys}


class Features:
    """The bins (or, given ``places``, what they map to) of the restored words of texts."""

    def __init__(self, costs: np.ndarray, places: dict[int, int] | None = None):
        self.decoder, self.places = Decoder(costs), places
        self.known: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}

    def _token(self, token: str) -> tuple[int, ...]:
        key = bare(token)
        out = self.bare.get(key)
        if out is None:
            out = self._bare(key)
            if len(self.bare) >= MEMORY:
                self.bare.clear()
            self.bare[key] = out
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[token] = out
        return out

    def _bare(self, token: str) -> tuple[int, ...]:
        found: set[int] = set()
        for word in self.decoder.word(token).split():
            if len(word) > 2:
                found |= _bins(word)
        if self.places is not None:
            found = {self.places[b] for b in found if b in self.places}
        return tuple(found)

    def of(self, text: str | None) -> set[int]:
        if not text:
            return set()
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self.decoder.span(m.group()), text)
        out: set[int] = set()
        known = self.known
        for token in set(text.split()):
            found = known.get(token)
            if found is None:
                found = self._token(token)
            if found:
                out.update(found)
        return out


@dataclass
class Model:
    costs: np.ndarray
    bins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def probability(self, places: set[int]) -> float:
        if self.bias == -np.inf:
            return 0.0
        z = self.bias + sum(self.weights[i] for i in places)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def restore(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """``doc_id, text, restored``: every whole text and its restored words."""
    sent = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in _text.chunks(batches):
            texts = batch.column(1).to_pylist()
            restored = pa.array([None if t is None else decoder.text(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), restored], names=["doc_id", "text", "restored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, restored string")


def sample_labels(labels: DataFrame, label: str, learn: Column | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, label, weight``: at most ``per_class`` ids of each class, in md5 order; the weight
    makes up for the ids left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    order = F.md5(F.col("doc_id").cast("string"))
    parts = []
    for value in (0, 1):
        n = totals.get(value, 0)
        weight = F.lit(n / max(min(n, per_class), 1))
        parts.append(known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class).withColumn("weight", weight))
    return parts[0].unionByName(parts[1])


def _choose(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Bins by the standardised difference of their document rates; ``counts``: (2, BINS)."""
    n0, n1 = np.maximum(totals, 1)
    rate = counts.sum(0) / (n0 + n1)
    z = np.abs(counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n0 + 1 / n1))
    z[counts.sum(0) < 5] = 0
    best = np.lexsort((np.arange(BINS), -z))[:CHOSEN]
    return np.sort(best[z[best] > MIN_Z])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Language model of all ``docs`` and classifier of the label rows for which ``learn`` holds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    model = Model(language_model(trigram_counts(docs)))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.costs)
    sample = sample_labels(labels, label, learn, per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", "weight")  # 2 * per_class ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(sent.value)
        for batch in _text.chunks(batches):
            bins = [np.array(sorted(found.of(t)), np.int32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bins, pa.binary())], names=["label", "weight", "bins"])

    known = materialize(rows.mapInArrow(features, "label int, weight double, bins binary"), "toxicity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for y, bins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y] += 1
                totals[y][np.frombuffer(bins, np.int32)] += 1
        at = np.flatnonzero(totals.sum(0) > 0)
        yield pa.RecordBatch.from_pydict({"bin": pa.array([-1, *at], pa.int64()), "clean": pa.array([seen[0], *totals[0][at]], pa.int64()), "toxic": pa.array([seen[1], *totals[1][at]], pa.int64())})

    table = known.select("label", "bins").mapInArrow(count, "bin long, clean long, toxic long").groupBy("bin").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("bin < 0 OR clean + toxic >= 5").toArrow()  # at most BINS rows
    bins, clean, toxic = (table.column(c).to_numpy() for c in ("bin", "clean", "toxic"))
    counts = np.zeros((2, BINS + 1), np.int64)
    counts[:, bins] = clean, toxic  # the last entry: rows
    totals, counts = counts[:, -1], counts[:, :-1]
    if totals.min() == 0:
        return model
    model.bins = _choose(counts, totals)
    places = {int(b): i for i, b in enumerate(model.bins)}
    n = len(places)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, n + 1))
            for i, b in enumerate(batch.column(2).to_pylist()):
                out[i, [places[x] for x in np.frombuffer(b, np.int32).tolist() if x in places]] = 1
            x = pa.ListArray.from_arrays(np.arange(0, out.size + 1, n + 1, dtype=np.int32), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), batch.column(1), x], names=["label", "weight", "x"])

    shown = known.mapInArrow(presence, "label double, weight double, x array<double>")
    patterns = shown.groupBy("x", "label").agg(F.sum("weight").alias("weight")).select("label", "weight", array_to_vector("x").alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False, weightCol="weight").fit(materialize(patterns, "toxicity-fit"))
    model.weights, model.bias = fitted.coefficients.toArray(), float(fitted.intercept)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.costs, model.bins, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, bins, weights, bias = sent.value
        here = Model(costs, bins, weights, bias)
        found = Features(costs, {int(b): i for i, b in enumerate(bins)})
        for batch in _text.chunks(batches):
            p = np.array([here.probability(found.of(t)) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
