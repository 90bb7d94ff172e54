"""Quality classifier by co-training a text view and a page-metadata view.

Two targets are learned from the same machinery: low quality and toxic. For each, a text classifier
(hashed words chosen by their log-odds, plus character statistics of the whole text) and a metadata
classifier (language, source, length) are fitted on a bounded labelled sample; over ``ROUNDS``
rounds each view scores all unlabelled documents on the executors and gives the other a draw of its
confident pseudo-labels. Each view's logit is then calibrated, and both are combined, by a logistic fit on a held-out fold. Every
document, whole text, is scored on the executors. A document is rejected when a combined probability
reaches the target's limit: at least 0.5, and high enough that at most ``FALSE_REJECTS`` of the
good documents reach it, of the held-out ones and of all that are known.

Bounds: ``PER_CLASS`` labelled documents of each of (good, low quality, toxic) are fitted on, taken
in md5 order of their ids. In each round every document that the target has no label for is scored
by each view; all confident ones are fitted on, or where there are more than ``POOL`` of a label, a
seeded draw over all of them of ``POOL`` expected documents, a new one each time. Word counts are
taken and words chosen on the executors; only chosen words and statistics of the sample and of the
draws reach the driver. Scores cover all rows.

Defined cases
-------------
* null text: empty text; null metadata: a value of its own; a label row with a null id or null label
  is not used for that target; two labels for one id: the larger value counts. A document with a
  null id, or with a null label for a target, is unlabelled there.
* unlabelled rows equal in id, text, language and source are drawn together, as one.
* no labels at all, or one class only: probability 0, nothing is rejected.
* repeated rows and ids: each row is scored on its own. Empty table: empty result.
* extra columns stay in ``keep``; names used here do not clash, features are taken by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm import _text
from credence.llm._scratch import materialize
from credence.operators.skew import spread_lookup

PER_CLASS = 4000
POOL = 4000
ROUNDS = 3
BINS = 1 << 18
CHOSEN = 400
FALSE_REJECTS = 0.003
CONFIDENT = (0.01, 0.95)
TARGETS = ("low_quality", "toxic")
BROADCAST_LABELS = 500_000  # labelled ids that are sent to all tasks; more meet their documents by a shuffle
META_SLOTS = 64  # hashed values of each of lang and source

_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[128:] = True
_MARKS = b"!|%#$&*,.@"
_SPACES = ~_text.NOT_SPACE


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bin) of every word, and dense statistics per document."""
    starts, ends, first = _text.words(data, offsets, _LETTERS)
    hashes = _text.word_hashes(data, starts, ends, fold=True)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(offsets) - 1), n_words)
    bins = (hashes % np.uint64(BINS)).astype(np.int64)
    size = np.maximum(np.diff(offsets), 1)
    line_starts, line_ends, line_first = _text.words(data, offsets, np.arange(256) != 10)
    lines = _text.word_hashes(data, line_starts, line_ends)
    line_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(line_first))
    order = np.lexsort((lines, line_doc))
    new = np.ones(len(lines), bool)
    if len(lines) > 1:
        new[1:] = (lines[order][1:] != lines[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])
    distinct_lines = np.bincount(line_doc[order][new], minlength=len(size))
    shares = [_per_doc(data == m, offsets) / size for m in _MARKS]
    shares.append(_per_doc((data >= 65) & (data <= 90), offsets) / size)
    shares.append(_per_doc((data >= 48) & (data <= 57), offsets) / size)
    shares.append(_per_doc(_SPACES[data], offsets) / size)
    shares.append(np.diff(offsets) / np.maximum(n_words, 1) / 20)
    shares.append(distinct_lines / np.maximum(np.diff(line_first), 1))
    shares.append(np.log1p(np.diff(offsets)) / 12)
    again = np.zeros(len(hashes), bool)  # the word before is the same
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shares.append(np.bincount(doc[again], minlength=len(size)) / np.maximum(n_words, 1))
    shares.append(np.bincount(np.unique(doc * BINS + bins) // BINS, minlength=len(size)) / np.maximum(n_words, 1))
    return doc, bins, np.sqrt(np.abs(np.stack(shares, 1)))


def meta_codes(lang: list, source: list, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: codes of lang and source (hashes of the whole values), and its size."""

    def slot(value: str | None) -> int:
        if value is None:
            return 0
        return 1 + int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little") % (META_SLOTS - 1)

    slots: dict = {}
    lang, source = (np.fromiter((slots[v] if v in slots else slots.setdefault(v, slot(v)) for v in x), np.int64, len(x)) for x in (lang, source))
    return lang, source, np.log1p(np.maximum(n_chars, 0)) / 12


@dataclass
class Rows:
    """Feature rows: a few dense columns behind ``wide`` columns of which each row has some (value 1),
    as (row, column) pairs. Products with weights cost as much as there are pairs."""

    row: np.ndarray
    column: np.ndarray
    wide: int
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=len(self)) + self.dense @ w[self.wide :]

    def under(self, r: np.ndarray) -> np.ndarray:
        """The columns' sums weighted by ``r``."""
        return np.append(np.bincount(self.column, weights=r[self.row], minlength=self.wide), r @ self.dense)

    def above(self, other: Rows) -> Rows:
        row = np.concatenate([self.row, other.row + np.int32(len(self))], dtype=np.int32)
        return Rows(row, np.concatenate([self.column, other.column]), self.wide, np.concatenate([self.dense, other.dense]))


def meta_rows(lang: np.ndarray, source: np.ndarray, size: np.ndarray) -> Rows:
    columns = np.stack([lang, META_SLOTS + source, 2 * META_SLOTS + np.minimum((size * 12).astype(int), 12)], 1)
    return Rows(np.repeat(np.arange(len(size), dtype=np.int32), 3), columns.ravel().astype(np.int32), 2 * META_SLOTS + 13, size[:, None].astype(np.float32))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: Rows, y: np.ndarray, l2: float = 1e-3, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Weights (last: bias) of a class-balanced logistic fit by Adam over all rows."""
    balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, m, v = (np.zeros(x.wide + x.dense.shape[1] + 1) for _ in range(3))
    for t in range(1, steps + 1):
        r = (_sigmoid(x @ w[:-1] + w[-1]) - y) * balance
        g = np.append(x.under(r) + l2 * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class View:
    """One target's two classifiers, their combination and the rejection limit."""

    bins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    text: np.ndarray = field(default_factory=lambda: np.zeros(0))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    combine: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: float = 2.0

    def chosen(self, doc: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place in ``bins``) of the chosen words."""
        at = np.searchsorted(self.bins, bins)
        hit = np.zeros(len(bins), bool)
        inside = at < len(self.bins)
        hit[inside] = self.bins[at[inside]] == bins[inside]
        return doc[hit], at[hit]

    def rows(self, doc: np.ndarray, at: np.ndarray, dense: np.ndarray) -> Rows:
        return Rows(doc.astype(np.int32), at.astype(np.int32), len(self.bins), ((dense - self.centre) / self.scale).astype(np.float32))

    def probability(self, doc: np.ndarray, bins: np.ndarray, dense: np.ndarray, meta: Rows) -> np.ndarray:
        if len(self.combine) == 0:
            return np.zeros(len(dense))
        a = self.rows(*_distinct(*self.chosen(doc, bins)), dense) @ self.text[:-1] + self.text[-1]
        b = meta @ self.meta[:-1] + self.meta[-1]
        return _sigmoid(a * self.combine[0] + b * self.combine[1] + self.combine[2])


def _distinct(doc: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(doc * BINS + bins)
    return pair // BINS, pair % BINS


def _choose(bins: np.ndarray, pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The bins whose document rates differ most between the classes (standardised). ``pos``, ``neg``:
    documents of each class that have the bin; ``n1``, ``n0``: documents of each class."""
    n1, n0 = max(n1, 1), max(n0, 1)
    p = (pos + neg) / (n1 + n0)
    z = np.abs(pos / n1 - neg / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[pos + neg < 5] = 0
    best = np.lexsort((bins, -z))[:CHOSEN]
    return np.sort(bins[best[z[best] > 5.5]])


def _fold(ids: np.ndarray) -> np.ndarray:
    """Whether a labelled document is held out."""
    return _text.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(4) == 0


def _binary(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """``values`` of each of ``n`` documents, in document order, as bytes."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(document, value) of what ``_binary`` made."""
    data, offsets = _text.utf8(column)
    values = np.frombuffer(data.tobytes(), dtype)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // values.itemsize), values


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _one(table: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.column_names)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict]:
    """For columns (text, lang, source, n_chars): (document, bin) of the distinct words, and the
    columns dense, lang, source, size."""
    data, offsets = _text.utf8(batch.column(0))
    doc, bins, dense = text_features(data, offsets)
    doc, bins = _distinct(doc, bins)
    lang, source, size = _codes_of(batch, 1)
    n = batch.num_rows
    columns = {"dense": _binary(np.repeat(np.arange(n), dense.shape[1]), dense.astype(np.float32).ravel(), n), "lang": pa.array(lang), "source": pa.array(source), "size": pa.array(size)}
    return doc, bins, columns


_REST = "dense binary, lang long, source long, size double, low_quality double, toxic double"
_NARROW = f"key long, words_low_quality binary, words_toxic binary, {_REST}"


def _rest(batch: pa.RecordBatch) -> dict:
    return {c: batch.column(c) for c in ("dense", "lang", "source", "size", "low_quality", "toxic")}


def _view_rows(batch: pa.RecordBatch, name: str, target: str, view: View) -> Rows:
    """One view's features of narrow rows."""
    if name == "meta":
        return meta_rows(*(batch.column(c).to_numpy() for c in ("lang", "source", "size")))
    dense = _values(batch.column("dense"), np.float32)[1].reshape(batch.num_rows, len(view.centre))
    return view.rows(*_values(batch.column(f"words_{target}"), np.uint16), dense)


def _confident(batch: pa.RecordBatch, name: str, views: dict[str, View], priors: dict[str, float]) -> dict[str, np.ndarray]:
    """Each target's confident labels by one view for the rows without a label there, else NaN."""
    out = {}
    for t, view in views.items():
        w = getattr(view, name)
        p = _sigmoid(_view_rows(batch, name, t, view) @ w[:-1] + w[-1])
        p = p * priors[t] / (p * priors[t] + (1 - p) * (1 - priors[t]))  # the fit is class-balanced: back to the sample's odds
        out[t] = np.where(p <= CONFIDENT[0], 0.0, np.where(p >= CONFIDENT[1], 1.0, np.nan))
        out[t][~np.isnan(_numbers(batch.column(t)))] = np.nan
    return out


def _draw(rows: DataFrame, name: str, views: dict[str, View], priors: dict[str, float], pool: int, seed: int) -> dict[str, pa.RecordBatch]:
    """Per target: narrow rows with one view's confident labels in place of the target's, drawn over
    all of ``rows``; each label has ``pool`` expected rows, or all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * len(views), np.int64)
        for batch in batches:
            got = _confident(batch, name, views, priors)
            n += [int((y == v).sum()) for y in got.values() for v in (0, 1)]
        yield pa.RecordBatch.from_pydict({"label": pa.array(np.arange(len(n))), "n": pa.array(n)})

    counts = np.zeros(2 * len(views))
    found = rows.mapInArrow(count, "label long, n long").groupBy("label").sum("n").toArrow()
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shares = dict(zip(views, (pool / np.maximum(counts, 1)).reshape(-1, 2), strict=True))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # equal rows have equal keys: drawn ones only
        for batch in batches:
            keys = batch.column("key").to_numpy()
            u = _text.mix(keys.view(np.uint64) + np.uint64(seed)) / 2.0**64
            got = _confident(batch, name, views, priors)
            for t, y in got.items():
                y[~(u < np.where(y > 0.5, shares[t][1], shares[t][0]))] = np.nan
            take = np.zeros(len(keys), bool)
            for i in np.flatnonzero(np.any([~np.isnan(y) for y in got.values()], axis=0)):
                take[i] = keys[i] not in seen
                seen.add(keys[i])
            none = np.full(len(keys), np.nan)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {t: pa.array(got.get(t, none), from_pandas=True) for t in TARGETS}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(take))

    got = _one(rows.mapInArrow(draw, _NARROW).toArrow())
    keys, first = np.unique(got.column("key").to_numpy(), return_index=True)
    got = got.take(pa.array(first))
    return {t: got.filter(got.column(t).is_valid()) for t in views}


def _finish(view: View, text: Rows, meta: Rows, y: np.ndarray, fold: np.ndarray) -> None:
    """Calibrates and combines the two views on the held-out labelled rows; sets the limit."""
    known = ~np.isnan(y)
    held = known & fold
    logits = np.stack([text @ view.text[:-1] + view.text[-1], meta @ view.meta[:-1] + view.meta[-1]], 1)
    scale = np.maximum(logits[held].std(0), 1e-6)
    use = np.ones(2)
    for _ in range(2):  # a view whose logit falls with the target on held-out rows is left out
        none = np.zeros(0, np.int32)
        w = _logistic(Rows(none, none, 0, logits[held] / scale * use), y[held], max(1e-3, 2 / held.sum()), steps=400)
        use *= w[:2] > 0
    view.combine = np.append(np.maximum(w[:2], 0) * use / scale, w[2])
    reach = [_sigmoid(logits[s & (y == 0)] @ view.combine[:2] + view.combine[2]) for s in (held, known)]
    view.limit = max(0.5, *(float(np.quantile(good, 1 - FALSE_REJECTS)) + 1e-6 for good in reach))


def _known(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, low_quality, toxic) of the ids with a label for one target at least."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        (1 - F.max("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    return known.filter(F.col("low_quality").isNotNull() | F.col("toxic").isNotNull())


def _sample(docs: DataFrame, known: DataFrame, id_col: str, per_class: int, seed: str) -> DataFrame:
    """The rows of ``known`` in the bounded sample."""
    order: Column = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    bad, toxic = F.coalesce(F.col("low_quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = known.join(ids, id_col, "left_semi")
    parts = [known.filter(c).orderBy(order).limit(per_class) for c in (bad, toxic & ~bad, ~bad & ~toxic)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _labelled(rows: DataFrame) -> DataFrame:
    """Features of labelled rows (id, text, lang, source, n_chars, low_quality, toxic) with all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            doc, bins, columns = _features(batch.select([1, 2, 3, 4]))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.int64()), "words": _binary(doc, bins.astype(np.uint32), batch.num_rows), **columns,
                                              "low_quality": batch.column(5).cast(pa.float64()), "toxic": batch.column(6).cast(pa.float64())})

    return materialize(rows.mapInArrow(run, f"id long, words binary, {_REST}"), "quality-labelled")


def _chosen_bins(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Each target's chosen bins, from counts over the training rows that are taken on the executors."""
    names = [f"{t}_{v}" for t in TARGETS for v in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, bins = _values(batch.column("words"), np.uint32)
            train = ~_fold(batch.column("id").to_numpy())
            sets = [train & (_numbers(batch.column(t)) == v) for t in TARGETS for v in (0, 1)]
            n = np.stack([np.append(np.bincount(bins[s[doc]], minlength=BINS), s.sum()) for s in sets])  # last: documents
            some = np.flatnonzero(n.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x) for x in n[:, some])], names=["bin", *names])

    counts = labelled.mapInArrow(run, ", ".join(["bin long", *(f"{c} long" for c in names)])).groupBy("bin").agg(*(F.sum(c).alias(c) for c in names))
    got = counts.toArrow().sort_by("bin")  # at most BINS + 1 rows
    bins, n = got["bin"].to_numpy(), np.zeros(4, np.int64)
    columns = [got[c].to_numpy() for c in names]
    if len(bins):
        n[:] = [c[bins == BINS].sum() for c in columns]
    word = bins < BINS
    return {t: _choose(bins[word], columns[2 * i + 1][word], columns[2 * i][word], n[2 * i + 1], n[2 * i]) for i, t in enumerate(TARGETS)}


def _unlabelled(docs: DataFrame, known: DataFrame, views: dict[str, View], id_col: str) -> DataFrame:
    """Narrow rows of all documents without a label for one of the targets in ``views``."""
    keyed = docs.select("text", "lang", "source", "n_chars", F.col(id_col).alias("__id"), F.xxhash64(id_col, "text", "lang", "source").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            doc, bins, columns = _features(batch)
            words = {}
            for t in TARGETS:
                d, at = views[t].chosen(doc, bins) if t in views else (doc[:0], bins[:0])
                words[f"words_{t}"] = _binary(d, at.astype(np.uint16), batch.num_rows)
            yield pa.RecordBatch.from_pydict({"__id": batch.column(4), "key": batch.column(5), **words, **columns})

    rows = keyed.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, {_NARROW.rsplit(', ', 2)[0]}")
    known = materialize(known.withColumnRenamed(id_col, "__id"), "quality-known")
    if known.count() <= BROADCAST_LABELS:
        rows = rows.join(F.broadcast(known), "__id", "left")
    else:
        rows = spread_lookup(rows.withColumn("__nth", F.monotonically_increasing_id()), known, "__id", F.col("__nth"))
    rows = rows.withColumns({t: F.col(t).cast("double") for t in TARGETS})
    return materialize(rows.filter(" OR ".join(f"{t} IS NULL" for t in views)).select(*[c.split()[0] for c in _NARROW.split(", ")]), "quality-unlabelled")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_class: int = PER_CLASS, pool: int = POOL, seed: str = "quality") -> dict[str, View]:
    """The two targets' models. ``docs``: id, text, lang, source, n_chars; ``labels``: id, quality, toxic."""
    known = _known(labels, id_col)
    sample = F.broadcast(_sample(docs, known, id_col, per_class, seed))  # at most 3 * per_class rows
    labelled = _labelled(docs.select(id_col, "text", "lang", "source", "n_chars").join(sample, id_col))
    models = {t: View(bins=bins) for t, bins in _chosen_bins(labelled).items()}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, bins = _values(batch.column("words"), np.uint32)
            words = {f"words_{t}": models[t].chosen(doc, bins) for t in TARGETS}
            yield pa.RecordBatch.from_pydict({"key": batch.column("id")} | {c: _binary(d, at.astype(np.uint16), batch.num_rows) for c, (d, at) in words.items()} | _rest(batch))

    got = _one(labelled.mapInArrow(narrow, _NARROW).toArrow().sort_by([(c, "ascending") for c in ("key", "source", "lang", "size")]))
    fold = _fold(got.column("key").to_numpy())
    ys = {t: _numbers(got.column(t)) for t in TARGETS}
    views = {t: v for t, v in models.items() if all(len(np.unique(ys[t][~np.isnan(ys[t]) & s])) == 2 for s in (fold, ~fold))}
    if views:
        _co_train(got, ys, fold, views, _unlabelled(docs, known, views, id_col), pool)
    return {t: views.get(t, View()) for t in TARGETS}


def _co_train(got: pa.RecordBatch, ys: dict[str, np.ndarray], fold: np.ndarray, views: dict[str, View], rows: DataFrame, pool: int) -> None:
    """Fits ``views``. ``got``: narrow labelled rows; ``ys``: their labels, NaN where unknown; ``fold``:
    held out; ``rows``: all rows without a label."""
    train = {t: ~np.isnan(ys[t]) & ~fold for t in views}
    dense = _values(got.column("dense"), np.float32)[1].reshape(got.num_rows, -1).astype(float)
    for t, view in views.items():
        view.centre, view.scale = dense[train[t]].mean(0), dense[train[t]].std(0) + 1e-3
    priors = {t: float(ys[t][train[t]].mean()) for t in views}
    given: dict[str, pa.RecordBatch] = {}
    for step in range(2 * ROUNDS):
        name = ("text", "meta")[step % 2]
        for t, view in views.items():
            x, y = _view_rows(got.filter(pa.array(train[t])), name, t, view), ys[t][train[t]]
            if t in given:  # the other view's labels
                x, y = x.above(_view_rows(given[t], name, t, view)), np.concatenate([y, _numbers(given[t].column(t))])
            setattr(view, name, _logistic(x, y, max(1e-4, 0.3 / len(y))))
        if step < 2 * ROUNDS - 1:
            given = _draw(rows, name, views, priors, pool, step + 1)
    for t, view in views.items():
        _finish(view, *(_view_rows(got, name, t, view) for name in ("text", "meta")), ys[t], fold)


def _codes_of(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_chars = batch.column(at + 2).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return meta_codes(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), np.nan_to_num(n_chars))


def _probabilities(batch: pa.RecordBatch, model: dict[str, View]) -> tuple[list[np.ndarray], np.ndarray]:
    """For columns (text, lang, source, n_chars): each target's probability, and whether to keep."""
    data, offsets = _text.utf8(batch.column(0))
    doc, bins, dense = text_features(data, offsets)
    meta = meta_rows(*_codes_of(batch, 1))
    p = [model[t].probability(doc, bins, dense, meta) for t in TARGETS]
    keep = np.ones(batch.num_rows, bool)
    for t, x in zip(TARGETS, p, strict=True):
        keep &= x < model[t].limit
    return p, keep


def score(docs: DataFrame, model: dict[str, View], id_col: str = "doc_id") -> DataFrame:
    """Per row: id, quality (probability of good quality), toxic (probability), accepted."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            (low, toxic), keep = _probabilities(batch.select(["text", "lang", "source", "n_chars"]), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 - low), pa.array(toxic), pa.array(keep)], names=[id_col, "quality", "toxic", "accepted"])

    return docs.select(id_col, "text", "lang", "source", "n_chars").mapInArrow(run, f"`{id_col}` {id_type}, quality double, toxic double, accepted boolean")


def keep(docs: DataFrame, model: dict[str, View]) -> DataFrame:
    """The accepted rows of ``docs``, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            yield batch.filter(pa.array(_probabilities(batch.select(["text", "lang", "source", "n_chars"]), model)[1]))

    return docs.mapInArrow(run, docs.schema)
