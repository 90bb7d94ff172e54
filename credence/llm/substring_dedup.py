"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A document's windows of ``WINDOW`` words are dealt into *segments* by their anchor: the smallest
hash among the window's runs of ``ANCHOR`` words (leftmost if equal). Equal windows have equal
anchors at equal places, so documents with a common window meet in the reference block of its
anchor. A block (one anchor's segments, in id order) is indexed by (place, window); each segment is
parsed greedily against the part of the block that earlier documents filled: a factor runs on while
the next window is found in the index under the same earliest source, and is at least ``WINDOW``
words long. At a factor's end the next window, which overlaps it by all but one word, is looked up
anew, so no duplicate across factor boundaries is missed. Windows are judged on the input; the words
covered by factors are removed.

Equality is that of the 64-bit anchor hashes, the anchor's place and the windows' 64-bit hashes.
Blocks of more than ``HOT_ROWS`` segments are parsed window by window with salted aggregates instead,
so one passage in a third of all documents is neither held nor read by one task; as all their windows
share one anchor, they are also compared by a second 64-bit hash over other byte codes.

Defined cases
-------------
* null text: no words. Texts under ``WINDOW`` words: nothing removed.
* null id: never a source, nothing removed. Rows of one id: none is a source for the other; rows of
  one id and one text share their result.
* repeats inside one document are kept (the source must have a smaller id).
* empty table: empty result. Extra columns are kept; result columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import _text
from credence.operators.skew import attach
from credence.llm._runs import whole_groups
from credence.llm._scratch import materialize

WINDOW = 50
ANCHOR = 20
HOT_ROWS = 50_000
PRINT_BYTES = 8  # of one window hash
PARSE_ROWS = 30_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each window of ``width`` values."""
    m, at = values, np.arange(len(values), dtype=np.int32)
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = m[:-step], m[step:]
        take = right < left
        m, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        have += step
    return at


def segments(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int, prints: int = 1) -> tuple[np.ndarray, ...]:
    """Per segment: document, its first window (words from 0), the anchor's place in that window,
    the number of windows, the anchor's hash; and ``prints`` (1 or 2) independent hashes of all windows in segment order."""
    starts, ends, first = _text.words(data, offsets)
    hashes = _text.word_hashes(data, starts, ends)
    n = np.diff(first)
    counts = np.maximum(n - window + 1, 0)
    at = _text.ranges(first[:-1], counts)  # first words of the windows
    if len(at) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros((0, prints), np.uint64)
    doc = np.repeat(np.arange(len(n)), counts)
    grams = _text.run_hashes(hashes, anchor)
    owner = _sliding_min(grams, window - anchor + 1)[at].astype(np.int64)
    words = [hashes] + [_text.word_hashes(data, starts, ends, seed=1)] * (prints - 1)
    whole = np.stack([_text.run_hashes(h, window)[at] for h in words], 1)
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    word = at[begin]
    return doc[begin], word - first[doc[begin]], owner[begin] - word, size, grams[owner[begin]], whole


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))


def _segment_rows(keyed: DataFrame, window: int, anchor: int, prints: int) -> DataFrame:
    """(anchor) of every segment, or with ``prints`` (anchor, id, fp, start, place, windows): the
    windows as their first or, one after the other, their two hashes."""
    width = prints * PRINT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            doc, start, place, size, key, whole = segments(*_text.utf8(batch.column(2)), window, anchor, max(prints, 1))
            out = {"anchor": pa.array(key.view(np.int64))}
            if prints:
                body = whole.astype("<u8").tobytes()
                ends = np.concatenate([[0], np.cumsum(size) * width]).astype(np.int32)
                at = pa.array(doc)
                out |= {
                    "id": batch.column(0).take(at), "fp": batch.column(1).take(at), "start": pa.array(start, pa.int32()), "place": pa.array(place, pa.int32()),
                    "windows": pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)]),
                }
            yield pa.RecordBatch.from_pydict(out)

    schema = "anchor long" + (", id long, fp long, start int, place int, windows binary" if prints else "")
    return keyed.mapInArrow(run, schema)


def _windows(table: pa.Table, prints: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments: window hashes, the row of each, its number in the row, and rows' sizes."""
    bodies = table.column("windows").to_pylist()
    size = np.array([len(b) // (prints * PRINT_BYTES) for b in bodies], np.int64)
    hashes = np.frombuffer(b"".join(bodies), "<u8").reshape(-1, prints)
    row = np.repeat(np.arange(len(bodies)), size)
    return hashes, row, _text.ranges(np.zeros(len(size), np.int64), size), size


def parse(table: pa.Table, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Factors of the segments of whole blocks, sorted by (anchor, id): id, fp, start, end, source."""
    block = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ids = table.column("id").to_numpy()
    lone = ids[at[:-1]] == ids[at[1:] - 1]  # blocks of one document have nothing to parse
    table, block = table.filter(pa.array(~lone[block])), block[~lone[block]]
    ids = table.column("id").to_numpy()
    hashes, row, nth, _ = _windows(table, 1)
    print_ = hashes[:, 0]
    key = block[row] * 64 + table.column("place").to_numpy()[row] - nth
    order = np.lexsort((print_, key))  # stable, rows are in id order: the first of equal ones is the earliest
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (print_[order][1:] != print_[order][:-1])
    source = np.empty(len(key), np.int64)
    source[order] = ids[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = source < ids[row]
    go_on = np.zeros(len(key), bool)
    go_on[1:] = hit[1:] & hit[:-1] & (row[1:] == row[:-1]) & (source[1:] == source[:-1])
    first = np.flatnonzero(hit & ~go_on)
    last = np.flatnonzero(hit & ~np.append(go_on[1:], False))
    r = row[first]
    start = table.column("start").to_numpy()[r] + nth[first]
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids[r]), "fp": pa.array(table.column("fp").to_numpy()[r]), "start": pa.array(start.astype(np.int32)),
        "end": pa.array((start + nth[last] - nth[first] + window).astype(np.int32)), "source": pa.array(source[first]),
    })


_FACTOR = "id long, fp long, start int, end int, source long"


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, start, end, source): words [start, end) of the document stand in document ``source``,
    the smallest id that has them. ``fp`` is xxhash64 of the text."""
    if window - anchor >= 64 or not 0 < anchor <= window:
        raise ValueError("anchor must be 1 to window words, and window - anchor under 64")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = _keyed(docs, id_col, text_col)
    counts = _segment_rows(keyed, window, anchor, prints=0).groupBy("anchor").count()
    hot = materialize(counts.filter(F.col("count") > hot_rows).select("anchor"), "hot-anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 1, PARSE_ROWS, 16 << 20):
            yield parse(table, at, window)

    cold = _segment_rows(keyed, window, anchor, prints=1).join(hot, "anchor", "left_anti").select("anchor", "id", "fp", "start", "place", "windows")
    cold = cold.repartition(parts, "anchor").sortWithinPartitions("anchor", "id").mapInArrow(run, _FACTOR)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row, nth, _ = _windows(pa.Table.from_batches([batch]), 2)
            at = pa.array(row)
            yield pa.RecordBatch.from_pydict({
                "anchor": batch.column(0).take(at), "place": pa.array((batch.column(4).to_numpy()[row] - nth).astype(np.int32)), "print": pa.array(hashes[:, 0].astype(np.int64)), "print2": pa.array(hashes[:, 1].astype(np.int64)),
                "id": batch.column(1).take(at), "fp": batch.column(2).take(at), "start": pa.array((batch.column(3).to_numpy()[row] + nth).astype(np.int32)),
            })

    if hot.isEmpty():
        return cold
    single = _segment_rows(keyed, window, anchor, prints=2).join(hot, "anchor", "left_semi").select("anchor", "id", "fp", "start", "place", "windows").mapInArrow(
        explode, "anchor long, place int, print long, print2 long, id long, fp long, start int")
    single = materialize(single, "hot-windows")
    single = attach(single, ["anchor", "place", "print", "print2"], F.col("id"), {"__m": F.min("id")}, {"source": F.min("__m")})
    single = single.filter(F.col("source") < F.col("id"))
    return cold.unionByName(single.select("id", "fp", "start", (F.col("start") + window).cast("int").alias("end"), "source"))


def _kept(data: np.ndarray, offsets: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, removed words and the remaining words joined by one space, per document."""
    starts, ends, first = _text.words(data, offsets)
    n = np.diff(first)
    cover = np.zeros(len(starts) + 1, np.int64)
    for d, s in enumerate(spans):
        if s:
            edges = np.array([(x["start"], x["end"]) for x in s], np.int64) + first[d]
            np.add.at(cover, edges[:, 0], 1)
            np.add.at(cover, edges[:, 1], -1)
    stay = np.cumsum(cover[:-1]) == 0
    doc = np.repeat(np.arange(len(n)), n)
    removed = np.bincount(doc[~stay], minlength=len(n))
    lengths = (ends - starts)[stay] + 1  # with the space after it
    out = np.append(data, np.uint8(32))[_text.ranges(starts[stay], lengths)]
    stops = np.cumsum(lengths)
    out[stops - 1] = 32
    bytes_ = np.bincount(doc[stay], weights=lengths, minlength=len(n)).astype(np.int64)
    limits = np.cumsum(bytes_)
    drop = limits[bytes_ > 0] - 1  # no space at a document's end
    out = np.delete(out, drop)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(bytes_ - 1, 0))]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])
    return n, removed, text.cast(pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (without its text) with n_words, n_removed and kept_text."""
    found = factors(docs, window, anchor, hot_rows, id_col, text_col)
    spans = found.groupBy(F.col("id").alias("__id"), F.col("fp").alias("__print")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept_text")]
    rows = docs.withColumn("__fp", F.xxhash64(text_col))
    rows = rows.join(spans, (rows[id_col] == spans["__id"]) & (rows["__fp"] == spans["__print"]), "left").select(F.col(text_col).alias("__text"), "__spans", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches, "__text"):
            n, removed, text = _kept(*_text.utf8(batch.column(0)), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(n), pa.array(removed), text], names=[*rest, "n_words", "n_removed", "kept_text"])

    fields = [f for f in rows.schema.fields if f.name in rest]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long", "n_removed long", "kept_text string"])
    return rows.mapInArrow(run, schema)
