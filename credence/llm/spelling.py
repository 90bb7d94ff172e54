"""Spelling variants grouped over permuterm rotations.

A word w = XY has, for each split, the rotation Y$X ($ is a terminator that sorts before all letters).
The words X?Y are then the rotations that continue the prefix Y$X by one character, so replacing the
skipped character, or leaving it out (the rotation Y$X itself), needs no search: rotations are sorted
by prefix, and one scan over each prefix range sees all words that differ there. A range holds at
most one word without the character and one per letter, so ranges stay small whatever the corpus,
and no pair is formed: each member takes the range's count and its best other member (the first or
the second of the range). A replacement has one place. A left-out character that repeats its right
neighbour could stand at several places; only the last of such a run counts.

The rotations are dealt by their prefix, sorted by Spark and scanned in Arrow batches; only a range
that is cut by a batch's end is carried over.

Defined cases
-------------
* null text: no words; null doc_id: the empty string where an id is asked for.
* ties: the smallest word in code-point order. Repeated rows: every row's occurrences count.
* empty table: empty result. Extra columns are ignored. Words with U+0000 are refused (an error).
* very long texts and words: whole; a word of L characters has 2L + 1 rotations of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm._scratch import materialize

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
_END = "\x00"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, word``: every maximal letter run of at least ``min_length`` characters, A-Z lowered."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUNS), F.lit(0))
    return docs.select("doc_id", F.explode(F.filter(found, lambda w: F.char_length(w) >= min_length)).alias("word"))


def without(word: Column, at: Column) -> Column:
    """``word`` less its character ``at`` (from 0)."""
    at = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def count_words(occurrences: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words long and frequent enough; counted per task before they are shuffled."""
    long = occurrences.filter(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, skipped, apart, n``: per word and split the prefix it completes (skipped = '') and per
    character the prefix that skips it. ``apart``: the character differs from its right neighbour."""
    word = F.when(F.instr("word", _END) > 0, F.raise_error(F.lit("words must not contain U+0000")).cast("string")).otherwise(F.col("word"))

    def entry(i: Column, left: int) -> Column:
        """The rotation behind the first i characters; ``left`` of the next ones are skipped."""
        prefix = F.concat(F.substring(F.col("w"), i + 1 + left, F.char_length("w")), F.lit(_END), F.substring(F.col("w"), F.lit(1), i))
        skipped = F.substring(F.col("w"), i + 1, F.lit(left))
        apart = skipped != F.substring(F.col("w"), i + 2, F.lit(1)) if left else F.lit(True)
        return F.struct(prefix.alias("prefix"), skipped.alias("skipped"), apart.alias("apart"))

    size = F.char_length("w")
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: entry(i, 0))
    skip = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: entry(i, 1))).otherwise(F.array().cast("array<struct<prefix:string,skipped:string,apart:boolean>>"))
    return words.select(word.alias("w"), "n").select(F.explode(F.concat(whole, skip)).alias("e"), "n").select("e.*", "n")


_FOUND = pa.schema([("prefix", pa.string()), ("skipped", pa.string()), ("near", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])
_FOUND_SQL = "prefix string, skipped string, near long, other string, other_n long"


def _ranges(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbours in whole prefix ranges; rows sorted by prefix, in it the complete word first, then by
    falling n and rising character."""
    prefix, skipped, n = rows.column("prefix"), rows.column("skipped"), rows.column("n").to_numpy(zero_copy_only=False)
    size = rows.num_rows
    new = np.ones(size, bool)
    new[1:] = pc.not_equal(prefix.slice(1), prefix.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(new)
    width = np.diff(np.append(start, size))
    keep = width > 1
    start, width = start[keep], width[keep]
    complete = pc.equal(skipped, "").to_numpy(zero_copy_only=False)
    apart = rows.column("apart").to_numpy(zero_copy_only=False)
    has = complete[start]
    top = start + has  # best word with a character here
    letters = width - has
    # every row of these ranges, with its range
    at = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())
    group = np.repeat(np.arange(len(start)), width)
    out = []  # (row, near words, best of them)
    lettered = ~complete[at]
    several = lettered & (letters[group] > 1)
    mine, g = at[several], group[several]
    out.append((mine, letters[g] - 1, np.where(mine == top[g], top[g] + 1, top[g])))
    longer = lettered & has[group] & apart[at]
    mine, g = at[longer], group[longer]
    out.append((mine, np.ones(len(mine), np.int64), start[g]))
    # the complete word: its longer neighbours, all letters here but the one that repeats its right one
    counts = np.bincount(group[lettered & apart[at]], minlength=len(start))
    first = top.copy()
    if len(top):
        second = ~apart[np.minimum(top, size - 1)]
        first[second] += 1
    some = has & (counts > 0)
    out.append((start[some], counts[some], first[some]))
    mine, near, best = (np.concatenate(c) for c in zip(*out, strict=True))
    take = pa.array(mine)
    return pa.RecordBatch.from_arrays(
        [prefix.take(take), skipped.take(take), pa.array(near, pa.int64()), skipped.take(pa.array(best)), pa.array(n[best], pa.int64())], schema=_FOUND
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        prefix = rows.column("prefix")
        differs = pc.not_equal(prefix, prefix[-1]).to_numpy(zero_copy_only=False)
        whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if whole:
            yield _ranges(rows.slice(0, whole))
        held = rows.slice(whole)
    if held is not None and held.num_rows:
        yield _ranges(held)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of ``word, n`` rows with distinct words: words that differ by one
    inserted, deleted or replaced character; words without any are left out."""
    ranged = rotations(words).repartition("prefix")
    ordered = ranged.sortWithinPartitions("prefix", F.col("skipped") != "", F.desc("n"), "skipped")
    found = ordered.mapInArrow(_scan, _FOUND_SQL)
    cut = F.instr("prefix", _END)
    right, left = F.substring(F.col("prefix"), F.lit(1), cut - 1), F.substring(F.col("prefix"), cut + 1, F.char_length("prefix"))
    best = F.struct((-F.col("other_n")).alias("n"), F.concat(left, F.col("other"), right).alias("word"))
    return (
        found.select(F.concat(left, F.col("skipped"), right).alias("word"), "near", best.alias("best"))
        .groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
        .select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` rows (null forms are left out) whose forms never run in a circle:
    every round doubles the steps followed, so a chain of length L takes log2(L) rounds."""
    hops = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        hops = materialize(hops, "roots")
        if hops.filter("moved").isEmpty():
            return hops.drop("moved")
        step = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = hops.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` rows with distinct words. ``form``: the near
    word of largest n, if that is at least ``ratio`` (over 1) times the word's; ``root``: where the
    forms lead."""
    words = materialize(words.select("word", "n"), "words")
    near = words.join(neighbours(words), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    linked = materialize(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    return linked.join(roots(linked), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
