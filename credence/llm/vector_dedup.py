"""Embedding near-dedup with spherical-cap filters from structured random product codes.

Vectors are rotated by a seeded random orthogonal matrix and cut in two halves; each half has B
random unit code words, and a filter direction is the concatenation of one code word from each, so
B * B filters need only 2 * B inner products. List decoding enumerates, for each vector, all filters
it exceeds at its own cap height: the r-th and s-th best code words of the halves can only be among
the L best sums if r * s <= L, so the other pairs are never looked at. Vectors that share a filter
(and label) are compared by cosine in double precision. B grows with the number of distinct vectors,
so a filter holds about as many unrelated vectors at any size; the height leaves a vector 16
filters up to B = 128 and 8 more for each doubling of B, which keeps the recall (tests, README).

A pair is counted in the smallest filter both exceed, so counts need no list of pairs: each task
returns link counts per vector and star edges per local component. A filter with more than
``BLOCK_ROWS`` vectors is split into blocks, and each pair of blocks is compared on its own. Equal
vectors are compared once, as a class.

Defined cases
-------------
* null label, null vector, zero vector, null or non-finite components: links with nothing.
* vectors of different lengths never link. A null id is returned with component null, no links.
* rows of one id are one node; each row counts as a vector of its own and has its own n_links, also
  where one id has unlike vectors.
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.operators.skew import attach
from credence.llm._runs import whole_groups
from credence.llm._scratch import materialize
from credence.llm.components import components, stars

THRESHOLD = 0.93
MIN_FILTERS = 16
MIN_WORDS = 64
BLOCK_ROWS = 2000
PAIR_ROWS = 64  # filters with up to so many vectors are compared many at once
PAIR_CHUNK = 50_000
SEED = 20


class Code:
    """The product code for vectors of ``dim`` components."""

    def __init__(self, dim: int, words: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = max(1, dim // 2)
        sizes = (self.half, max(1, dim - self.half))
        # short halves take at most 2 ** size code words: very short vectors exceed every filter
        self.words = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((min(words, 2 ** min(n, 32)), n)) for n in sizes)]
        self.filters = max(MIN_FILTERS, 8 * (words.bit_length() - 1) - 40)
        # the r-th and s-th best code words can be among the best L sums only if r * s <= L
        n, m = (min(len(w), self.filters) for w in self.words)
        self.pairs = np.nonzero(np.outer(np.arange(1, n + 1), np.arange(1, m + 1)) <= self.filters)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter), ascending: all filter directions that each unit vector exceeds at its
        own cap height, which is that of its ``filters``-th best direction."""
        x = unit @ self.turn
        halves = (x[:, : self.half], x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1)))
        scores = [h @ w.T for h, w in zip(halves, self.words, strict=True)]
        rank = [np.argsort(-s, axis=1, kind="stable")[:, : self.filters] for s in scores]
        a, b = (np.take_along_axis(s, k, 1) for s, k in zip(scores, rank, strict=True))
        r, q = self.pairs
        best = np.argsort(-(a[:, r] + b[:, q]), axis=1, kind="stable")[:, : self.filters]
        f = np.take_along_axis(rank[0], r[best], 1) * len(self.words[1]) + np.take_along_axis(rank[1], q[best], 1)
        return np.repeat(np.arange(len(x)), f.shape[1]), np.sort(f, axis=1).ravel()


def _units(bodies: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1).astype(float)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _compare(table: pa.Table, at: np.ndarray, threshold: float, kind: str) -> pa.RecordBatch:
    """Link counts (u, mark, null, n) and star edges (u, null, v, 0) of whole (filter, block pair) groups."""
    ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
    own, filter_ = table.column("own").to_numpy(), table.column("filter").to_numpy()
    cross = table.column("i").to_numpy() != table.column("j").to_numpy()
    lists = table.column("filters").combine_chunks()
    counts = np.zeros(len(ids), np.int64)
    ends_a, ends_b = [], []
    size = np.diff(at)

    bodies = table.column("vector").to_pylist()
    small = np.flatnonzero((size > 1) & (size <= PAIR_ROWS))
    by_dim: dict[int, list[int]] = {}
    for g in small.tolist():
        by_dim.setdefault(len(bodies[at[g]]), []).append(g)
    for groups in by_dim.values():
        m = size[groups]
        rows = np.concatenate([np.arange(at[g], at[g + 1]) for g in groups])
        unit = np.zeros((len(ids), len(bodies[rows[0]]) // np.dtype(kind).itemsize))
        unit[rows] = _units([bodies[r] for r in rows.tolist()], kind)
        # each row against the rows after it in its group
        last = np.repeat(at[np.array(groups) + 1], m)
        n_after = last - rows - 1
        a = np.repeat(rows, n_after)
        b = _after(rows, n_after)
        for lo in range(0, len(a), PAIR_CHUNK):
            x, y = a[lo : lo + PAIR_CHUNK], b[lo : lo + PAIR_CHUNK]
            ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[ok], y[ok]
            ok = ~cross[x] | (own[x] != own[y])
            x, y = x[ok], y[ok]
            ends_a.append(x)
            ends_b.append(y)
            first = np.array([_first_common(lists[p], lists[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
            once = first == filter_[x]
            np.add.at(counts, x[once], times[y[once]])
            np.add.at(counts, y[once], times[x[once]])

    for g in np.flatnonzero(size > PAIR_ROWS).tolist():
        s = slice(int(at[g]), int(at[g + 1]))
        unit = _units(bodies[s], kind)
        near = unit @ unit.T >= threshold
        if cross[s.start]:
            near &= own[s][:, None] != own[s][None, :]
        np.fill_diagonal(near, False)
        here = lists.slice(s.start, s.stop - s.start)
        values, row = here.flatten().to_numpy(), np.repeat(np.arange(len(unit)), here.value_lengths().to_numpy())
        earlier = values < filter_[s.start]
        kinds, column = np.unique(values[earlier], return_inverse=True)
        seen = np.zeros((len(unit), len(kinds)), np.float32)
        seen[row[earlier], column] = 1
        counts[s] += (near & (seen @ seen.T == 0)) @ times[s]
        x, y = np.nonzero(np.triu(near))
        x, y = stars(x, y, len(unit))
        ends_a.append(x + s.start)
        ends_b.append(y + s.start)

    a = np.concatenate(ends_a) if ends_a else np.zeros(0, np.int64)
    b = np.concatenate(ends_b) if ends_b else np.zeros(0, np.int64)
    u, v = stars(a, b, len(ids))
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_pydict({
        "u": pa.array(np.concatenate([ids[some], ids[u]])),
        "mark": pa.concat_arrays([pa.array(table.column("mark").to_numpy()[some]), pa.nulls(len(u), pa.int64())]),
        "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[v])]),
        "n": pa.array(np.concatenate([counts[some], np.zeros(len(u), np.int64)])),
    })


def _after(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.repeat(rows + 1 - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _first_common(a: pa.Scalar, b: pa.Scalar) -> int:
    return min(set(a.as_py()) & set(b.as_py()))


def link_counts(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id, kept."""
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    x = F.col(vector_col) if single else F.transform(F.col(vector_col), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), x.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    classes = attach(
        rows.filter("usable").drop("usable"), ["label", "vector"], F.col("id"),
        {"__m": F.min("id"), "__n": F.count(F.lit(1)), "__h": F.min(F.xxhash64("label", "vector"))},
        {"class": F.min("__m"), "times": F.sum("__n"), "mark": F.min("__h")},
    )
    # a class is known by its smallest id and a hash: one id may have several vectors
    member = materialize(classes.select("id", "label", "class", "mark", "times", "vector"), "vector-classes")
    reps = member.filter("id = class").dropDuplicates(["id", "label", "vector"])
    words = MIN_WORDS
    while words * words < reps.count():
        words *= 2

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                values = part.column(3)
                dims = values.value_lengths().to_numpy()
                for dim in np.unique(dims).tolist():
                    which = np.flatnonzero(dims == dim)
                    raw = values.take(pa.array(which)).flatten().to_numpy().astype(float).reshape(len(which), dim)
                    code = codes.setdefault(dim, Code(dim, words))
                    v, f = code.decode(raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None])
                    at = np.searchsorted(v, np.arange(len(which) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))
                    bodies = pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())
                    one, per = pa.array(which[v]), pa.array(v)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(v), dim, np.int32)), part.column(1).take(one), pa.array(f), part.column(0).take(one),
                        part.column(2).take(one), bodies.take(per), lists.take(per), part.column(4).take(one),
                    ], names=["dim", "label", "filter", "id", "times", "vector", "filters", "mark"])

    schema = "dim int, label string, filter long, id long, times long, vector binary, filters array<int>, mark long"
    spread = reps.select("id", "label", "times", "vector", "mark").repartition(parts, "id").mapInArrow(decode, schema)
    spread = materialize(spread, "caps")
    key = ["dim", "label", "filter"]
    full = spread.groupBy(*key).count().filter(F.col("count") > 1)
    placed = spread.join(full, key)  # a filter with one vector has nothing to compare
    blocks = F.ceil(F.col("count") / F.lit(BLOCK_ROWS)).cast("int")
    placed = placed.withColumn("__b", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("__b")).cast("int"))
    placed = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1))).select(
        *key, F.least("own", "__o").alias("i"), F.greatest("own", "__o").alias("j"), "own", "id", "times", "vector", "filters", "mark")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 5, 8000):
            yield _compare(table, at, threshold, kind)

    order = [*key, "i", "j"]
    found = placed.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, "u long, mark long, v long, n long")
    found = materialize(found, "vector-links")
    direct = found.filter("v IS NULL").groupBy(F.col("u").alias("class"), "mark").agg(F.sum("n").alias("__links"))
    same = member.select(F.col("id").alias("u"), F.col("class").alias("v"))
    groups = components(found.filter("v IS NOT NULL").select("u", "v").unionByName(same), "vector-links")
    # every usable row is a member of one class, and each copy of its vector is another link
    linked = member.select("id", "class", "mark", "times").join(direct, ["class", "mark"], "left")
    linked = linked.select("id", F.lit(True).alias("usable"), (F.coalesce("__links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"))
    rest = rows.filter(~F.col("usable")).select("id", "usable", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(rest).join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
