"""Harmonic packing of token sequences into bins of a power-of-two capacity.

A document's ids (with the end id) are cut into whole bins, then into falling power-of-two parts of
at least ``min_piece`` tokens, then one tail. The class of a piece is its length L; the reciprocal
capacity 1 / k with k = capacity // L says how many pieces of the class fill a bin, so a piece's bin
and offset follow from its rank in the class alone. Tasks number their pieces per class on their
own; prefix sums of the tasks' class counts turn these numbers into ranks. No ids are shuffled.

Bins of power-of-two classes have no padding. What is left over in a class after its last full bin
stays without padding too: left-over tails (fewer than k a class, whatever the input's size) are cut
into power-of-two parts, and the c left-over pieces of a power-of-two class go to one bin for each
bit of c. Padding is therefore less than ``min_piece`` ids in the full bins of short tails only.

Defined cases
-------------
* null or empty text: one id, the end id. Null id: kept; rows of one id are packed each on its own.
* a very long document: many whole bins, streamed in batches of bounded size.
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm import _encode, _text
from credence.llm._scratch import materialize

CAPACITY = 2048
MIN_PIECE = 64
BATCH_IDS = 1_000_000  # ids in one batch of pieces, at least one piece


def cut(lengths: np.ndarray, capacity: int, min_piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with these lengths."""
    docs, starts, sizes = [], [], []
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    docs.append(doc)
    starts.append(_text.ranges(np.zeros(len(lengths), np.int64), whole) * capacity)
    sizes.append(np.full(len(doc), capacity))
    at, rest = whole * capacity, lengths % capacity
    part = capacity // 2
    while part >= min_piece:
        has = np.flatnonzero(rest >= part)
        docs.append(has)
        starts.append(at[has])
        sizes.append(np.full(len(has), part))
        at[has] += part
        rest[has] -= part
        part //= 2
    has = np.flatnonzero(rest)
    docs.append(has)
    starts.append(at[has])
    sizes.append(rest[has])
    doc, start, size = np.concatenate(docs), np.concatenate(starts), np.concatenate(sizes)
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, min_piece: int, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encode.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each class so far in this task
        for batch in _text.chunks(batches):
            data, offsets = _text.utf8(batch.column(1))
            ids, first = enc.encode(data, offsets)
            ids = np.insert(ids, first[1:], end_id).astype("<u4")
            first = first + np.arange(len(first))
            lengths = np.diff(first)
            doc, start, size = cut(lengths, capacity, min_piece)
            order = np.argsort(size, kind="stable")
            _, begin, n = np.unique(size[order], return_index=True, return_counts=True)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(begin, n)
            nth += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            ends = np.cumsum(size)  # pieces lie in the order of the ids
            at = 0
            while at < len(size):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + BATCH_IDS, "right")))
                body = ids[base : ends[to - 1]].tobytes()
                cuts = np.concatenate([[0], (ends[at:to] - base) * 4]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc[at:to])), pa.array(start[at:to]), pa.array(size[at:to]),
                    pa.array(lengths[doc[at:to]]), pa.array(np.full(to - at, part, np.int32)), pa.array(nth[at:to]),
                    pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(body)]),
                ], names=[id_col, "start", "length", "doc_tokens", "part", "nth", "ids"])
                at = to

    schema = f"`{id_col}` {id_type}, start long, length long, doc_tokens long, part int, nth long, ids binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _is_power(length: Column) -> Column:
    return F.bit_count(length) == 1


def _bits_of(rest: Column, at: Column, length: Column, capacity: int) -> tuple[Column, Column]:
    """Bin and offset of the ``at``-th of ``rest`` left-over pieces: one bin for each bit of ``rest``."""
    index, offset = F.lit(None).cast("long"), F.lit(None).cast("long")
    for bit in range(capacity.bit_length()):
        low = F.shiftleft(F.shiftright(rest, bit + 1), bit + 1)  # pieces in the bins of the higher bits
        here = (F.shiftright(rest, bit).bitwiseAND(1) == 1) & (at >= low) & (at < low + (1 << bit))
        index = F.when(here, F.bit_count(F.shiftright(rest, bit + 1)).cast("long")).otherwise(index)
        offset = F.when(here, (at - low) * length).otherwise(offset)
    return index, offset


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, min_piece: int = MIN_PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit). Sequence ids run from 0 without gaps."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    pieces = materialize(_pieces(docs, tokenizer, end_id, capacity, min_piece, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    k = F.floor(F.lit(capacity) / F.col("length"))
    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).withColumn("k", k)
    classes = classes.withColumn("full", F.floor(F.col("n") / F.col("k")) * F.col("k"))
    # bases grow with the tasks (one row for each task and class): a written table, so the planner knows its
    # size and broadcasts it below its threshold only. classes: at most min_piece + log2(capacity) rows
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.drop("part", "nth", "base").join(F.broadcast(classes.select("length", "k", "full")), "length")
    tail = ~_is_power(F.col("length"))
    stays = ranked.filter(~tail | (F.col("rank") < F.col("full")))

    # left-over tails: bounded by the classes, not by the input
    loose = ranked.filter(tail & (F.col("rank") >= F.col("full")))
    bits = [b for b in range(min_piece.bit_length()) if 1 << b < min_piece]
    higher = [F.shiftleft(F.shiftright(F.col("length"), b + 1), b + 1) for b in bits]
    parts = F.filter(
        F.array(*[
            F.struct(h.alias("at"), F.lit(1 << b).cast("long").alias("size"), (F.shiftright(F.col("length"), b).bitwiseAND(1) == 1).alias("there"))
            for b, h in zip(bits, higher, strict=True)
        ]),
        lambda p: p["there"],
    )
    loose = loose.withColumn("p", F.explode(parts)).select(
        id_col, (F.col("start") + F.col("p.at")).alias("start"), F.col("length").alias("tail"), F.col("p.size").alias("length"), "doc_tokens", "rank",
        F.substring("ids", (F.col("p.at") * 4 + 1).cast("int"), (F.col("p.size") * 4).cast("int")).alias("ids"),
    )
    extra = loose.groupBy("length").agg(F.count(F.lit(1)).alias("extra"))
    total = classes.select("length", "n", "k").join(extra, "length", "full")
    total = total.select("length", F.coalesce("n", F.lit(0)).alias("old"), F.coalesce("extra", F.lit(0)).alias("extra"), F.floor(F.lit(capacity) / F.col("length")).alias("k"))
    power = _is_power(F.col("length"))
    n = F.col("old") + F.when(power, F.col("extra")).otherwise(0)
    total = total.withColumn("full", F.floor(n / F.col("k")) * F.col("k")).withColumn("rest", F.when(power, n - F.col("full")).otherwise(F.lit(0)).cast("long"))
    bins = (F.col("full") / F.col("k") + F.bit_count("rest")).cast("long")
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    total = total.withColumn("first_bin", F.coalesce(F.sum(bins).over(longer), F.lit(0)))

    nth = F.row_number().over(Window.partitionBy("length").orderBy("tail", "rank", "start")) - 1
    added = loose.withColumn("nth", nth).join(F.broadcast(total.select("length", "old")), "length")
    added = added.withColumn("rank", F.col("old") + F.col("nth")).drop("nth", "tail", "old")
    placed = stays.drop("k", "full").unionByName(added).join(F.broadcast(total), "length")
    at = F.col("rank") - F.col("full")
    index, offset = _bits_of(F.col("rest"), at, F.col("length"), capacity)
    in_full = at < 0
    sequence = F.col("first_bin") + F.when(in_full, F.floor(F.col("rank") / F.col("k"))).otherwise(F.col("full") / F.col("k") + index)
    return placed.select(
        id_col, "start", "length", "doc_tokens", sequence.cast("long").alias("sequence_id"),
        F.when(in_full, (F.col("rank") % F.col("k")) * F.col("length")).otherwise(offset).cast("long").alias("offset"), "ids",
    )
