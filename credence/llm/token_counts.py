"""Token counts of document sections by offset-mapped attribution.

Each whole document is encoded once; the tokens' character spans are interval-joined, inside the
Arrow batch, to the document's sections. Rule for tokens that cross a boundary: a token belongs to
the section that holds most of its characters, ties to the earlier section; characters outside all
sections do not count. A token that touches no section is reported under ``OUTSIDE``.

Defined cases
-------------
* null or empty text: every section has 0 tokens. Null or empty sections: all tokens are OUTSIDE.
* sections with null or negative or reversed limits, or beyond the text, are clipped to the text;
  an empty section has 0 tokens. Where sections overlap, the later one starts where the earlier ends.
* sections of one name in a document are summed. Repeated rows give repeated results per row: rows
  are told apart only by their id. A null id is kept.
* empty table: empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import _encode, _text

OUTSIDE = "(outside)"


def _clip(start: np.ndarray, end: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections, sorted by (doc, start), as disjoint spans of the chunk's characters."""
    low, high = chars[doc], chars[doc + 1]
    s = np.clip(start + low, low, high)
    e = np.clip(end + low, low, high)
    # each section starts no earlier than every earlier section of its document has ended
    reach = np.maximum.accumulate(np.concatenate([[0], e[:-1]])) if len(e) else e
    s = np.maximum(s, reach)
    return s, np.maximum(s, e)


def attribute(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For token spans (n, 2) and sorted disjoint non-empty sections: the section of each token
    (-1: none), and whether it touches two or more."""
    if len(start) == 0 or len(tokens) == 0:
        return np.full(len(tokens), -1), np.zeros(len(tokens), bool)
    a, b = tokens[:, 0], tokens[:, 1]
    first = np.searchsorted(end, a, "right")
    last = np.searchsorted(start, b, "left") - 1
    best = np.where(first <= last, first, -1)
    crossing = first < last
    for t in np.flatnonzero(crossing):
        i, j = first[t], last[t] + 1
        best[t] = i + int(np.argmax(np.minimum(end[i:j], b[t]) - np.maximum(start[i:j], a[t])))
    return best, crossing


def section_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str = "sections") -> DataFrame:
    """One row per document and section name (plus OUTSIDE where it has tokens): id, section,
    n_tokens, n_crossing (of these, tokens that touch two or more sections).

    ``sections_col``: array<struct<name string, start int, end int>>, character offsets.
    ``tokenizer``: path of a tokenizer file that every worker can read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.transform(F.col(sections_col), lambda s: s["name"]).alias("names"),
        F.transform(F.col(sections_col), lambda s: F.coalesce(s["start"], F.lit(0)).cast("long")).alias("starts"),
        F.transform(F.col(sections_col), lambda s: F.coalesce(s["end"], F.lit(0)).cast("long")).alias("ends"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encode.encoder(tokenizer, offsets=True)
        for batch in _text.chunks(batches):
            data, offsets = _text.utf8(batch.column(1))
            _, first, spans = enc.encode_spans(data, offsets)
            chars = _encode.char_index(data)[offsets]
            n = np.array([0 if x is None else x for x in pa.compute.list_value_length(batch.column(2)).to_pylist()], np.int64)
            doc = np.repeat(np.arange(batch.num_rows), n)
            names = np.array(batch.column(2).flatten().to_pylist(), object)
            start = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            end = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((start, doc))
            doc, names = doc[order], names[order]
            s, e = _clip(start[order], end[order], doc, chars)
            full = np.flatnonzero(e > s)
            best, crossing = attribute(spans, s[full], e[full])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            hit = best >= 0
            per = np.bincount(full[best[hit]], minlength=len(doc)) if len(full) else np.zeros(len(doc), int)
            cross = np.bincount(full[best[hit & crossing]], minlength=len(doc)) if len(full) else np.zeros(len(doc), int)
            out: dict[tuple[int, str | None], list[int]] = {}
            for d, name, x, y in zip(doc.tolist(), names.tolist(), per.tolist(), cross.tolist(), strict=True):
                cell = out.setdefault((d, name), [0, 0])
                cell[0] += x
                cell[1] += y
            rest = np.bincount(owner[~hit], minlength=batch.num_rows)
            for d in np.flatnonzero(rest).tolist():
                out.setdefault((d, OUTSIDE), [0, 0])[0] += int(rest[d])
            ids = batch.column(0).take(pa.array([d for d, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([k for _, k in out], pa.string()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.int64())],
                names=[id_col, "section", "n_tokens", "n_crossing"],
            )

    return rows.mapInArrow(count, f"`{id_col}` {id_type}, section string, n_tokens long, n_crossing long")
