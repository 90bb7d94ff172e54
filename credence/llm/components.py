"""Connected components of an edge table by local contraction and star rounds.

Edges are dealt over tasks in chunks of about ``CHUNK_EDGES``; each task contracts its chunk to
stars on the chunk's smallest nodes. When there is one chunk, that is the result. Otherwise two star
rounds on aggregated neighbour minima follow (large star: neighbours above a node move to its
smallest neighbour; small star: neighbours below it move to the smallest of them), the edges are
written to the shared folder, and all is repeated until nothing changes: every node then hangs on
the smallest node of its component. No list of neighbours is ever collected, minima are combined
before the shuffle, and no task holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._scratch import materialize

CHUNK_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links (a, b) among nodes 0..n-1: each node that is not the smallest of its component, and
    that smallest node."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        for x in (before[a], before[b], a, b):  # roots, then the nodes themselves
            np.minimum.at(low, x, m)
        low = low[low]
        if (low == before).all():
            break
    x = np.flatnonzero(low != np.arange(n))
    return x, low[x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, root = stars(at[: len(u)], at[len(u) :], len(nodes))
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[x]), "v": pa.array(nodes[root])})


def _star(pairs: DataFrame, keep_above: bool) -> DataFrame:
    """For each node u with neighbours v and minimum m over them and itself: (v, m) edges."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(low, "u")
    moved = joined.filter(F.col("v") > F.col("u")) if keep_above else joined.filter(F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out if keep_above else out.unionByName(low.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components", chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another.
    ``edges`` has columns u, v (long); direction, repeats and loops do not matter."""
    pairs = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = materialize(pairs, name)
    before = _state(pairs)
    while before[0]:
        chunks = -(-before[0] // chunk_edges)
        local = pairs.repartition(chunks).mapInArrow(_contract, "u long, v long")
        if chunks == 1:
            pairs = materialize(local, name)
            break
        both = local.unionByName(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).filter(F.col("u") != F.col("v")).distinct()
        small = _star(large, False).filter(F.col("u") != F.col("v")).distinct()
        pairs = materialize(small, name)
        now = _state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
