"""Conversation structure repair with Four-Russians block tables.

A conversation's rows, in order, are edited at least cost so that the first characters of its roles
read ``(s?(ua)+)?``: keep a row, give it the role user or assistant, delete it, or insert a row with
an empty text. Blank and duplicate rows must be deleted; truncated ones cost extra unless deleted. Of
equally cheap edit strings the one that is least in ASCII order is taken.

Method. A row is one of nine symbols (must go; or one of four role kinds, truncated or not). The costs
to finish from each of four states (nothing yet, after s, after u, after a) form a vector; less its
minimum there are only a few such vectors, found by closure. A table gives, for every block of
``BLOCK`` symbols and every vector behind it, the vector before it, the cost added, and the state that
the best edits lead to from each state. Rows are processed from the last block to the first by lookup;
then each block is expanded backward from the vector behind it, and the edits are taken forward, in
ASCII order, wherever they meet the cost to finish. Since that cost is exact, ties fall to the least
string.

Distribution. Rows are range-partitioned and sorted by conversation and turn, so that a long
conversation is cut over many tasks. A conversation that lies whole inside one task is repaired there
at once. Every other one is a list of segments of at most ``SEGMENT_ROWS`` rows or ``SEGMENT_BYTES`` of text: first occurrences
of its rows are found by an aggregate over digests, each segment is looked up for all vectors and
states at once (a few hundred bytes), two streaming passes over these summaries fix the vector behind
and the state before each segment, and all segments are then traced in parallel. Both ways use the
same tables and functions.

``repair`` returns pieces: one row per whole conversation, one per segment of the others. The counts,
the cost and the edits of a conversation are the sums (in order, concatenations) of its pieces.
``digests`` makes them one row per conversation; a SHA-256 over a conversation is sequential, so the
pieces of one stream through one task, which holds its edits only (they are one value of the result).

Defined cases
-------------
* null role or text: one space (a role of an unknown kind, a blank text). Null turn: before all others.
  Null conversation id: a conversation of its own.
* ties of turn: by role, then by the first 64 characters of the text, then by a digest; equal rows
  are interchangeable, the first of them counts and the others are duplicates.
* rows whose ``present`` is false only keep their conversation in the result: zeros, no edits.
* gaps: missing turns between a conversation's smallest and largest, modulo 2**64.
* empty table: empty result. Extra columns are ignored. Very long texts: a segment of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from credence.llm import _text
from credence.llm._scratch import materialize

BLOCK = 4
SEGMENT_ROWS = 2000
SEGMENT_BYTES = 1 << 20
_SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row that is given a role or inserted, by the state before it.
_GIVEN = (USER, USER, ASSISTANT, USER)
#: The state behind a kept row, by its role's kind (s, u, a, other) and the state before it.
_KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
GONE = 0  # the symbol of a row that must be deleted; others: 1 + 2 * kind + truncated
SYMBOLS = 9


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Tables:
    """Cost vectors, their steps over one symbol and over every block of ``block`` symbols."""

    def __init__(self, costs: Costs, block: int = BLOCK):
        self.costs, self.block = costs, block
        end = self._with_inserts([0, None, None, 0])
        self.vectors = [self._normal(end)[0]]
        index = {self.vectors[0]: 0}
        steps: list[list[tuple[int, int, list]]] = []  # by vector, by symbol
        while len(steps) < len(self.vectors):
            after = self.vectors[len(steps)]
            row = []
            for symbol in range(SYMBOLS):
                costs_now = self._before(after, symbol)
                vector, add = self._normal(costs_now)
                if vector not in index:
                    index[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((index[vector], add, [self._moves(after, costs_now, symbol, q) for q in range(4)]))
            steps.append(row)
        #: The inserts that end a conversation, by state.
        self.ends = [self._ending(q) for q in range(4)]
        self.before = [[steps[v][s][0] for v in range(len(steps))] for s in range(SYMBOLS)]
        self.moves = [[steps[v][s][2] for v in range(len(steps))] for s in range(SYMBOLS)]
        one = np.array(self.before, np.int64)
        one_add = np.array([[steps[v][s][1] for v in range(len(steps))] for s in range(SYMBOLS)], np.int64)
        one_exit = np.array([[[m[1] for m in self.moves[s][v]] for v in range(len(steps))] for s in range(SYMBOLS)], np.int64)
        # a block is its first symbol and the block of one symbol less behind that
        n = len(steps)
        self.to, self.add = np.arange(n)[None, :], np.zeros((1, n), np.int64)
        self.exit = np.tile(np.arange(4), (1, n, 1))
        for _ in range(block):
            to = one[:, self.to]
            add = self.add[None] + one_add[:, self.to]
            entered = one_exit[:, self.to]  # symbol, block behind, vector, state
            out = np.take_along_axis(np.broadcast_to(self.exit[None], (SYMBOLS, *self.exit.shape)), entered, 3)
            self.to, self.add, self.exit = to.reshape(-1, n), add.reshape(-1, n), out.reshape(-1, n, 4)
        self.one, self.one_add, self.one_exit = one, one_add, one_exit

    @staticmethod
    def _normal(vector: list[int]) -> tuple[tuple[int, ...], int]:
        low = min(vector)
        return tuple(c - low for c in vector), low

    def _with_inserts(self, plain: list) -> list[int]:
        """Costs to finish when rows may be inserted first; None: no other way."""
        out = []
        for q in range(4):
            ways, at, paid = [], q, 0
            for _ in range(4):
                if plain[at] is not None:
                    ways.append(paid + plain[at])
                at, paid = _GIVEN[at], paid + self.costs.insert
            out.append(min(ways))
        return out

    def _edit(self, symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state behind) of the edits of one row, in ASCII order."""
        ways = [("D", self.costs.delete, q)]
        if symbol != GONE:
            kind, cut = divmod(symbol - 1, 2)
            extra = self.costs.truncated * cut
            if _KEPT[kind][q] is not None:
                ways.append(("K", self.costs.keep + extra, _KEPT[kind][q]))
            ways.append(("R", self.costs.rerole + extra, _GIVEN[q]))
        return ways

    def _before(self, after: tuple[int, ...], symbol: int) -> list[int]:
        return self._with_inserts([min(cost + after[to] for _, cost, to in self._edit(symbol, q)) for q in range(4)])

    def _moves(self, after: tuple[int, ...], now: list[int], symbol: int, q: int) -> tuple[str, int]:
        """The least cheapest edits up to and with this row, and the state behind it."""
        edits = ""
        while True:
            ways = [(e, cost + after[to], to) for e, cost, to in self._edit(symbol, q)]
            ways.append(("I", self.costs.insert + now[_GIVEN[q]], _GIVEN[q]))
            edit, q = min((e, to) for e, cost, to in ways if cost == now[q])
            edits += edit
            if edit != "I":
                return edits, q

    def _ending(self, q: int) -> str:
        edits = ""
        while q not in (START, ASSISTANT):
            q, edits = _GIVEN[q], edits + "I"
        return edits

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block codes of the leading whole blocks, and the symbols left over."""
        whole = len(symbols) // self.block * self.block
        weights = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        return symbols[:whole].astype(np.int64).reshape(-1, self.block) @ weights, symbols[whole:]

    def trace(self, symbols: np.ndarray, behind: int = 0, state: int = START, last: bool = True) -> tuple[str, int]:
        """Edits of rows followed by vector ``behind``, entered in ``state``, and the state after them."""
        codes, rest = self.codes(symbols)
        vector, borders = behind, []
        for s in rest[::-1].tolist():
            vector = self.before[s][vector]
        for code in codes[::-1].tolist():
            borders.append(vector)
            vector = int(self.to[code, vector])
        edits: list[str] = []
        at = 0
        for vector in [*borders[::-1], behind]:
            block = symbols[at : at + self.block].tolist()
            at += self.block
            vectors = [vector]
            for s in block[:0:-1]:  # expand the block backward
                vectors.append(self.before[s][vectors[-1]])
            for s, v in zip(block, vectors[::-1], strict=False):
                edit, state = self.moves[s][v][state]
                edits.append(edit)
        if last:
            edits.append(self.ends[state])
        return "".join(edits), state

    def summary(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind these rows: the vector before them, and the states after them (by
        the state before)."""
        codes, rest = self.codes(symbols)
        n = len(self.vectors)
        vectors = [np.arange(n)]
        tables = [(self.to, self.exit, c) for c in codes.tolist()] + [(self.one, self.one_exit, s) for s in rest.tolist()]
        for to, _, c in tables[::-1]:
            vectors.append(to[c][vectors[-1]])
        states = np.tile(np.arange(4), (n, 1))
        for (_, out, c), v in zip(tables, vectors[-2::-1], strict=True):
            states = np.take_along_axis(out[c][v], states, 1)
        return vectors[-1], states


@lru_cache(maxsize=4)
def tables(costs: Costs, block: int = BLOCK) -> Tables:
    """One set of tables per Python worker."""
    return Tables(costs, block)


def apply_edits(audit: str, rows: list[tuple[str, str, int, bool]], state: int, costs: Costs) -> tuple[list[dict], int]:
    """Repaired rows and cost of ``audit`` over rows (role, text, kind, truncated) entered in ``state``."""
    out, cost, at = [], 0, 0
    price = {"D": costs.delete, "I": costs.insert, "K": costs.keep, "R": costs.rerole}
    for edit in audit:
        cost += price[edit]
        if edit == "I":
            state = _GIVEN[state]
            out.append({"role": _ROLE[state], "text": ""})
            continue
        role, text, kind, cut = rows[at]
        at += 1
        if edit == "D":
            continue
        cost += costs.truncated * cut
        state = _KEPT[kind][state] if edit == "K" else _GIVEN[state]
        out.append({"role": role if edit == "K" else _ROLE[state], "text": text})
    return out, cost


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FRESH = pa.list_(pa.struct([("digest", pa.binary()), ("at", pa.int32())]))


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class _Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.size = conv, 0
        self.rows: list[tuple] = []  # role, text, kind, truncated
        self.turns: list = []
        self.blank: list[bool] = []
        self.digests: list[bytes] = []

    def borders(self) -> dict:
        """What a neighbouring segment needs to know."""
        known = [t for t in self.turns if t is not None]
        return {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
                "first_kind": self.rows[0][2] if self.rows else None, "last_kind": self.rows[-1][2] if self.rows else None}

    def inner(self) -> dict:
        """Gaps and illegal pairs between these rows."""
        known = [t for t in self.turns if t is not None]
        kinds = [r[2] for r in self.rows]
        return {"gaps": _long(sum(b - a - 1 for a, b in zip(known, known[1:], strict=False) if b != a)),
                "illegal": sum(p not in _LEGAL for p in zip(kinds, kinds[1:], strict=False))}

    def local_first(self) -> list[bool]:
        """Which rows are the first of their kind here."""
        seen: set[bytes] = set()
        out = []
        for d in self.digests:
            out.append(d not in seen)
            seen.add(d)
        return out


def _symbols(rows: list[tuple], blank: list[bool], first: list[bool]) -> tuple[np.ndarray, dict]:
    """Symbols, and the number of rows by their first fault."""
    out, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for (_, _, kind, cut), empty, fresh in zip(rows, blank, first, strict=True):
        out.append(GONE if empty or not fresh else 1 + 2 * kind + cut)
        if empty:
            faults["blank"] += 1
        elif not fresh:
            faults["duplicate"] += 1
        elif cut:
            faults["truncated"] += 1
    return np.array(out, np.int64), faults


def _schema(conv: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("conv_id", conv), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()),
        *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired", _REPAIRED),
        ("kinds", pa.binary()), ("fresh", _FRESH), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
        ("first_kind", pa.int32()), ("last_kind", pa.int32()),
    ])


def _ddl(schema: pa.Schema, conv: str) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary",
             _REPAIRED: "array<struct<role:string,text:string>>", _FRESH: "array<struct<digest:binary,at:int>>"}
    return ", ".join(f"{f.name} {conv if f.name == 'conv_id' else names[f.type]}" for f in schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += row.get("weight", 0)
        if len(held) >= size or weight > 4 * SEGMENT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(batches: Iterator[pa.RecordBatch], costs: Costs, segment_rows: int, segment_bytes: int) -> Iterator[dict]:
    """Pieces of conversations that are whole here, segments of the others."""
    table = tables(costs)
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    seq = 0

    def piece(run: _Run, whole: bool) -> dict:
        nonlocal seq
        seq += 1
        out = {"conv_id": run.conv, "part": part, "seq": seq, "whole": whole, **run.inner(), "weight": run.size}
        first = run.local_first()
        if whole:
            symbols, faults = _symbols(run.rows, run.blank, first)
            audit, _ = table.trace(symbols)
            repaired, cost = apply_edits(audit, run.rows, START, costs)
            return out | faults | {"cost": cost, "audit": audit, "repaired": repaired}
        kinds = bytes(k << 2 | c << 1 | b for (_, _, k, c), b in zip(run.rows, run.blank, strict=True))
        fresh = [{"digest": d, "at": i} for i, (d, f, b) in enumerate(zip(run.digests, first, run.blank, strict=True)) if f and not b]
        rows = [{"role": r, "text": t} for r, t, _, _ in run.rows]
        return out | run.borders() | {"kinds": kinds, "fresh": fresh, "repaired": rows}

    run: _Run | None = None
    inside = False  # the open run began behind another conversation of this task, and was not cut
    for batch in batches:
        for small in _text.chunks(iter([batch]), "text", segment_bytes):
            columns = [c.to_pylist() for c in small.columns]
            for conv, present, turn, role, text, kind, blank, cut, digest in zip(*columns, strict=True):
                if run is None or conv != run.conv:
                    if run is not None:
                        yield piece(run, inside)
                    inside = run is not None
                    run = _Run(conv)
                elif len(run.rows) >= segment_rows or run.size >= segment_bytes:
                    yield piece(run, False)
                    inside, run = False, _Run(conv)
                if present:
                    run.rows.append((role, text, kind, cut))
                    run.turns.append(turn)
                    run.blank.append(blank)
                    run.digests.append(digest)
                    run.size += len(text)
    if run is not None:
        yield piece(run, False)


def _sorted_rows(rows: DataFrame, present: Column) -> DataFrame:
    """Rows with their kind and faults, range-partitioned and sorted; equal rows may part anywhere."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    there = rows.select("conv_id", F.coalesce(present, F.lit(False)).alias("present"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    hide = {c: F.when(F.col("present"), F.col(c)) for c in ("turn", "role", "text")}
    there = there.withColumns(hide).fillna("", ["role", "text"])
    tail = F.rtrim(F.col("text"), F.lit(_SPACE))
    kind = F.expr("CASE substring(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    there = there.select(
        "conv_id", "present", "turn", "role", "text", kind.alias("kind"), (tail == "").alias("blank"),
        (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.spark_partition_id().alias("split"))
    order = ["conv_id", "present", "turn", "role", F.substring("text", 1, 64), "digest", "split"]
    return there.repartitionByRange(*order).sortWithinPartitions(*order).drop("split")


def _streamed(summaries: DataFrame, backward: bool, step, schema: pa.Schema, ddl: str) -> DataFrame:
    """``step(held, row) -> (held, new columns)`` over each conversation's segments in order."""
    order = [F.desc("part"), F.desc("seq")] if backward else ["part", "seq"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, held = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if held is None or row["conv_id"] != conv:
                        conv, held = row["conv_id"], ()
                    held, new = step(held, row)
                    yield row | new

        yield from _batches(rows(), schema)

    return summaries.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(walk, ddl)


def repair(
    rows: DataFrame, costs: Costs = Costs(), present: Column | None = None,  # noqa: B008
    segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """Pieces (conv_id, part, seq, whole, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired) of the rows ``conv_id, turn, role, text``; a conversation's pieces in the order of part
    and seq make it up. ``present``: false for rows that only name their conversation."""
    conv_arrow, conv_sql = to_arrow_type(rows.schema["conv_id"].dataType), rows.schema["conv_id"].dataType.simpleString()
    schema = _schema(conv_arrow)
    ordered = _sorted_rows(rows, F.lit(True) if present is None else present)
    cut = materialize(ordered.mapInArrow(lambda b: _batches(_cut(b, costs, segment_rows, segment_bytes), schema), _ddl(schema, conv_sql)), "dialogue")
    public = ["conv_id", "part", "seq", "whole", *_COUNTS, "audit", "repaired"]
    segments = cut.filter(~F.col("whole"))

    # rows that are the first of their kind in the whole conversation
    fresh = segments.select("conv_id", "part", "seq", F.explode("fresh").alias("f")).select("conv_id", "part", "seq", "f.*")
    firsts = fresh.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq", "at")).alias("f")).select("f.*")
    firsts = firsts.groupBy("part", "seq").agg(F.collect_list("at").alias("firsts"))  # at most segment_rows
    narrow = segments.select("conv_id", "part", "seq", "kinds", "first_turn", "last_turn", "first_kind", "last_kind")

    summary_schema = pa.schema([
        ("conv_id", conv_arrow), ("part", pa.int32()), ("seq", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
        ("first_kind", pa.int32()), ("last_kind", pa.int32()), ("symbols", pa.binary()),
        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("before", pa.binary()), ("states", pa.binary())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(costs)

        def each():
            for batch in batches:
                for row in batch.to_pylist():
                    first = set(row.pop("firsts") or ())
                    kinds = row.pop("kinds")
                    symbols, faults = _symbols([("", "", k >> 2, k >> 1 & 1) for k in kinds], [bool(k & 1) for k in kinds], [i in first for i in range(len(kinds))])
                    before, states = table.summary(symbols)
                    yield row | faults | {"symbols": symbols.astype(np.uint8).tobytes(), "before": before.astype(np.uint16).tobytes(), "states": states.astype(np.uint8).tobytes()}

        yield from _batches(each(), summary_schema)

    summaries = narrow.join(firsts, ["part", "seq"], "left").select(*narrow.columns, "firsts").mapInArrow(summarise, _ddl(summary_schema, conv_sql))

    def vector_behind(held, row):
        behind = held[0] if held else 0
        return (int(np.frombuffer(row["before"], np.uint16)[behind]),), {"behind": behind, "last": not held}

    behind_schema = summary_schema.append(pa.field("behind", pa.int32())).append(pa.field("last", pa.bool_()))
    behind = _streamed(summaries, True, vector_behind, behind_schema, _ddl(behind_schema, conv_sql))

    def state_before(held, row):
        state, turn, kind = held or (START, None, None)
        gaps = illegal = 0
        if turn is not None and row["first_turn"] is not None and row["first_turn"] != turn:
            gaps = row["first_turn"] - turn - 1
        if kind is not None and row["first_kind"] is not None:
            illegal = int((kind, row["first_kind"]) not in _LEGAL)
        out = np.frombuffer(row["states"], np.uint8).reshape(-1, 4)
        after = int(out[row["behind"], state])
        turn = row["last_turn"] if row["last_turn"] is not None else turn
        kind = row["last_kind"] if row["last_kind"] is not None else kind
        return (after, turn, kind), {"state": state, "more_gaps": _long(gaps), "more_illegal": illegal}

    placed_schema = behind_schema
    for name, kind in (("state", pa.int32()), ("more_gaps", pa.int64()), ("more_illegal", pa.int64())):
        placed_schema = placed_schema.append(pa.field(name, kind))
    placed = _streamed(behind, False, state_before, placed_schema, _ddl(placed_schema, conv_sql))

    piece_schema = pa.schema([schema.field(c) for c in public])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(costs)

        def each():
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    symbols = np.frombuffer(row["symbols"], np.uint8).astype(np.int64)
                    audit, _ = table.trace(symbols, row["behind"], row["state"], row["last"])
                    texts = [(r["role"], r["text"], k >> 2, k >> 1 & 1) for r, k in zip(row["repaired"], row["kinds"], strict=True)]
                    repaired, cost = apply_edits(audit, texts, row["state"], costs)
                    row |= {"whole": False, "gaps": _long(row["gaps"] + row["more_gaps"]), "illegal": row["illegal"] + row["more_illegal"], "cost": cost, "audit": audit, "repaired": repaired}
                    yield {c: row[c] for c in public} | {"weight": sum(len(t[1]) for t in texts)}

        yield from _batches(each(), piece_schema)

    joined = segments.select("conv_id", "part", "seq", "gaps", "illegal", "kinds", "repaired").join(placed.drop("conv_id", "first_turn", "last_turn", "first_kind", "last_kind", "before", "states"), ["part", "seq"])
    return cut.filter("whole").select(*public).unionByName(joined.mapInArrow(trace, _ddl(piece_schema, conv_sql)))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the counts, cost, audit, and repaired_sha256 over its
    repaired ``role:text`` rows joined by newlines."""
    conv = pieces.schema["conv_id"].dataType
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([("conv_id", to_arrow_type(conv)), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    line = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = pieces.filter("whole").withColumn("repaired_sha256", F.sha2(line, 256)).select(*columns)
    # the other pieces as bytes, each row led by a newline
    led = F.concat_ws("", F.transform("repaired", lambda r: F.concat(F.lit("\n"), r["role"], F.lit(":"), r["text"])))
    parted = pieces.filter(~F.col("whole")).select("conv_id", "part", "seq", *_COUNTS, "audit", led.alias("body"))
    parted = parted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(conv, totals, audit, digest):
            return {"conv_id": conv, **{c: _long(t) for c, t in zip(_COUNTS, totals, strict=True)}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        def each():
            held = None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if held is None or held[0] != row["conv_id"]:
                        if held:
                            yield finished(*held)
                        held = (row["conv_id"], [0] * len(_COUNTS), [], hashlib.sha256())
                        begun = False
                    _, totals, audit, digest = held
                    for k, c in enumerate(_COUNTS):
                        totals[k] += row[c]
                    audit.append(row["audit"])
                    body = row["body"].encode()
                    digest.update(body if begun else body[1:])
                    begun = begun or bool(body)
            if held:
                yield finished(*held)

        yield from _batches(each(), schema)

    return whole.unionByName(parted.mapInArrow(stream, f"conv_id {conv.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"))
