"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int, min_rows: int, max_bytes: int = 64 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by their first ``n_keys`` columns: tables of whole groups with at least
    ``min_rows`` rows or ``max_bytes`` (fewer at the end), and the groups' first rows plus the end.
    One group must fit in memory: callers split larger ones beforehand."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in range(n_keys):
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < min_rows and sum(b.nbytes for b in held) < max_bytes:
            continue
        table = pa.Table.from_batches(held)
        at = cut(table)
        if len(at) > 2:  # the last group may go on
            yield table.slice(0, int(at[-2])), at[:-1]
            held = table.slice(int(at[-2])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)
