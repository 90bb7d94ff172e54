"""N-gram Jaccard join by prefix trees: documents whose sets of word n-grams are similar enough.

1. Texts are dealt into groups by a hash of id and text; each group hashes its documents' shingle sets.
2. Document frequencies of all shingles are counted: groups send packed hashes to hash buckets and
   get a logarithmic frequency class for each back. (frequency class, hash) is the global order of
   the sets, rarest first.
3. A partner of a document with n shingles misses at most n - ceil(n * threshold) of them. A document
   with more shingles that nobody else has is done. For the others, two similar sets share one of
   their first n - ceil(n * threshold) + 1 shingles in the global order (prefix filter); equal sets
   are one class, and classes that share a prefix shingle, directly or in a chain, form a candidate
   group. Links can exist inside candidate groups only.
4. Each candidate group is joined by a prefix tree of its ordered sets: a probe descends the tree and
   shares the overlap counted on the common path; subtrees are left when the overlap so far plus the
   remaining length cannot reach the needed overlap, or when all their sets are already connected to
   the probe. Groups of more than ``BLOCK_SHINGLES`` shingles are split into blocks, and each pair of
   blocks is one task's work, so none is held whole.
5. Components of the links found; equal sets take their class's component.

Defined cases
-------------
* null or empty text: no shingles, linked with nothing. Fewer words than n: one shingle, the whole.
* null id: its row is returned with component null and links nothing. Rows with one id are one
  node: their links are joined; each row has its own n_shingles.
* threshold: links need 100 * |intersection| >= percent * |union|, in integers.
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import _text
from credence.operators.skew import attach
from credence.llm._runs import whole_groups
from credence.llm._scratch import materialize
from credence.llm.components import components

WORDS = 4
PERCENT = 85
BLOCK_SHINGLES = 500_000
EDGE_STEP = 128  # shingles of a tree edge between two looks at the bound


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document offsets): each document's distinct shingles, ascending."""
    starts, ends, first = _text.words(data, offsets)
    hashes = _text.word_hashes(data, starts, ends, fold=True)
    n = np.diff(first)
    runs = _text.run_hashes(hashes, k)
    counts = np.maximum(n - k + 1, 0)
    at = _text.ranges(first[:-1], counts)
    doc = np.repeat(np.arange(len(n)), counts)
    values = [runs[at]]
    docs = [doc]
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        if len(which):
            values.append(_text.run_hashes(hashes, short)[first[which]])
            docs.append(which)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _group_sets(table: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The group's rows in a fixed order, and their sets."""
    table = table.sort_by([("id", "ascending"), ("fp", "ascending")])
    parts, lengths = [], []
    for chunk in _text.chunks(iter(table.combine_chunks().to_batches())):
        value, first = shingle_sets(*_text.utf8(chunk.column(chunk.schema.get_field_index("text"))), k)
        parts.append(value)
        lengths.append(np.diff(first))
    if not parts:
        return table, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return table, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _blobs(body: bytes, ends: np.ndarray) -> pa.Array:
    """Binary array of the consecutive pieces of ``body`` that end at ``ends`` (bytes)."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def _spread(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts hashes by bucket (their first bits), stable, and the bucket limits."""
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange((1 << bits) + 1))


def _frequency_classes(sent: DataFrame, parts: int) -> DataFrame:
    """For packed hashes (bucket, g, hashes): (g, bucket, classes), one byte for each hash: 0 where
    no other document has it, else 1 + 4 * log2(count), at most 255."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 1, 1):
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                group = table.slice(lo, hi - lo)
                bodies = group.column("hashes").to_pylist()
                values = np.frombuffer(b"".join(bodies), "<u4")
                _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
                kind = np.where(counts == 1, 0, np.minimum(1 + 4 * np.log2(counts), 255)).astype(np.uint8)[inverse]
                ends = np.cumsum([len(b) // 4 for b in bodies])
                yield pa.RecordBatch.from_arrays([
                    group.column("g").combine_chunks(), group.column("bucket").combine_chunks(), _blobs(kind.tobytes(), ends),
                ], names=["g", "bucket", "classes"])

    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(classes, "g int, bucket int, classes binary")


def _limit(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles a partner may miss."""
    return n - (percent * n + 99) // 100


def candidates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, hashes, prefix) of every row; the last three are null where the document cannot
    have a partner. Materialised."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups, bits = 4 * parts, max(0, (parts - 1).bit_length() - 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(groups)).cast("int").alias("g"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"),
    ).repartition(parts, "g")

    def send(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        _, value, _ = _group_sets(table, k)
        order, at = _spread(value, bits)
        packed = (value[order] >> np.uint64(32 - bits)).astype("<u4")
        full = np.flatnonzero(np.diff(at))
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "g": pa.array(np.full(len(full), g), pa.int32()),
            "hashes": _blobs(packed.tobytes(), at[1:][full] * 4),
        })

    sent = rows.groupBy("g").applyInArrow(send, "bucket int, g int, hashes binary")
    replies = _frequency_classes(sent, parts).repartition(parts, "g")

    def judge(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        table, value, first = _group_sets(table, k)
        order, _ = _spread(value, bits)
        kind = np.zeros(len(value), np.uint8)
        if reply.num_rows:
            reply = reply.sort_by("bucket")
            kind[order] = np.frombuffer(b"".join(reply.column("classes").to_pylist()), np.uint8)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        alone = np.bincount(doc[kind == 0], minlength=len(n))
        limit = _limit(n, percent)
        known = table.column("id").is_valid().to_numpy()
        open_ = np.flatnonzero((n > 0) & (alone <= limit) & known)
        body = value.astype("<u8").tobytes()
        digests, sets, prefixes = ([None] * len(n) for _ in range(3))
        for d in open_.tolist():
            s = slice(first[d], first[d + 1])
            sets[d] = body[8 * first[d] : 8 * first[d + 1]]
            digests[d] = hashlib.blake2b(sets[d], digest_size=16).digest()
            ordered = value[s][np.argsort(kind[s], kind="stable")]  # by class, then hash
            prefixes[d] = ordered[alone[d] : limit[d] + 1].astype("<u8").tobytes()
        return pa.table({
            "id": table.column("id"), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "hashes": pa.array(sets, pa.binary()), "prefix": pa.array(prefixes, pa.binary()),
        })

    judged = rows.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(judge, "id long, n long, digest binary, hashes binary, prefix binary")
    return materialize(judged, "shingle-sets")


class Tree:
    """Compressed prefix tree of distinct ascending hash sequences."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        common = [0] + [self._common(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True)]
        self.common = np.array(common)
        # node: (edge, first leaf, end leaf, longest rest below, smallest and largest set, children)
        self.root = self._node(0, len(sets), 0)
        stack = [self.root]
        while stack:
            node = stack.pop()
            lo, hi, depth = node["lo"], node["hi"], node["depth"]
            if hi - lo > 1:
                inner = np.flatnonzero(self.common[lo + 1 : hi] == depth) + lo + 1
                limits = [lo, *inner.tolist(), hi]
                node["children"] = [self._node(a, b, depth) for a, b in zip(limits[:-1], limits[1:], strict=True)]
                stack += node["children"]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def _node(self, lo: int, hi: int, start: int) -> dict:
        depth = len(self.sets[lo]) if hi - lo == 1 else int(self.common[lo + 1 : hi].min())
        sizes = self.sizes[lo:hi]
        return {"edge": self.sets[lo][start:depth], "lo": lo, "hi": hi, "depth": depth, "rest": int(sizes.max()) - depth, "low": int(sizes.min()), "high": int(sizes.max()), "children": []}

    def links(self, percent: int) -> list[tuple[int, int]]:
        """A spanning set of the links: pairs whose components were apart when they were found."""
        group = np.arange(len(self.sets))
        out = []
        for x in range(1, len(self.sets)):
            probe, n = self.sets[x], len(self.sets[x])
            least = (percent * n + 99) // 100  # smaller sets cannot match, nor sets that need more than n
            most = 100 * n // percent
            stack = [(self.root, 0, 0)]
            while stack:
                node, overlap, at = stack.pop()
                lo, hi = node["lo"], min(node["hi"], x)
                if lo >= hi or node["high"] < least or node["low"] > most or (group[lo:hi] == group[x]).all():
                    continue
                partner = max(node["low"], least)
                need = -(-percent * (n + partner) // (100 + percent))
                edge, rest, open_ = node["edge"], node["rest"], True
                for i in range(0, len(edge), EDGE_STEP):
                    part = edge[i : i + EDGE_STEP]
                    where = np.searchsorted(probe, part)
                    inside = where < n
                    overlap += int((probe[where[inside]] == part[inside]).sum())
                    at = int(np.searchsorted(probe, part[-1], "right"))
                    if overlap + min(n - at, len(edge) - i - len(part) + rest) < need:
                        open_ = False
                        break
                if not open_:
                    continue
                if node["children"]:
                    stack += [(c, overlap, at) for c in node["children"]]
                elif 100 * overlap >= percent * (n + len(self.sets[lo]) - overlap):
                    out.append((x, lo))
                    group[group == group[lo]] = group[x]
        return out


def _join_blocks(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (u, v) inside the candidate groups of (component, id, n, hashes)."""
    blocks = F.ceil(F.col("__all") / F.lit(BLOCK_SHINGLES)).cast("int")
    rows = attach(sets, ["component"], F.col("id"), {"__s": F.sum("n")}, {"__all": F.sum("__s")}, source=sets.select("component", "id", "n"))
    rows = rows.withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("__blocks")).cast("int"))
    # a row of block b goes to the pairs (b, j >= b) and (i < b, b); one block: the pair (0, 0)
    other = F.explode(F.when(F.col("__blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda j: j != F.col("__own"))))
    rows = rows.withColumn("__other", other).select(
        "component", F.least("__own", "__other").alias("a"), F.greatest("__own", "__other").alias("b"), "id", "hashes")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 3, 2000):
            ids = table.column("id").to_numpy()
            bodies = table.column("hashes").to_pylist()
            u, v = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = [np.frombuffer(b, "<u8") for b in bodies[lo:hi]]
                order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
                for x, y in Tree([sets[i] for i in order]).links(percent):
                    u.append(int(ids[lo + order[x]]))
                    v.append(int(ids[lo + order[y]]))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.repartition(parts, "component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(join, "u long, v long")


def similar_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    judged = candidates(docs, k, percent, id_col, text_col)
    open_ = F.col("digest").isNotNull()
    member = attach(judged.filter(open_).select("id", "digest"), ["digest"], F.col("id"), {"__m": F.min("id")}, {"class": F.min("__m")})
    member = materialize(member.select("id", "class").distinct(), "set-classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            n = np.array([len(b) // 8 for b in bodies], np.int64)
            tokens = np.frombuffer(b"".join(bodies), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(tokens), batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))], names=["token", "id"])

    reps = member.filter("id = class").select("id").distinct()
    # rows of one id with different sets are one node: all their prefixes count
    tokens = judged.filter(open_).select("id", "prefix").join(reps, "id").mapInArrow(spread, "token long, id long")
    tokens = materialize(tokens, "prefix-shingles")
    chained = attach(
        tokens, ["token"], F.col("id"), {"__m": F.min("id"), "__c": F.count(F.lit(1))}, {"low": F.min("__m"), "__n": F.sum("__c")},
        then=lambda t: t.filter("__n > 1"),
    )
    groups = materialize(components(chained.select(F.col("id").alias("u"), F.col("low").alias("v")), "candidate-groups"), "candidate-groups")

    sets = judged.filter(open_).select("id", "n", "hashes").join(reps, "id").join(groups.withColumnRenamed("node", "id"), "id")
    links = materialize(_join_blocks(sets, percent, parts), "set-links")
    same = member.select(F.col("id").alias("u"), F.col("class").alias("v"))
    found = components(links.unionByName(same), "links")
    out = judged.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
