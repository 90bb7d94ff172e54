"""Exact dedup by two passes over a Bloom filter of repeated hashes (DataFrame functions only).

Pass 1 counts filter cells (two per row) and keeps, as 4 KB bitmaps, the cells that at least two
rows hit. Pass 2 tests every row: a row with a cell that nobody else hits is alone and passes
straight through with all its columns; only the possibly repeated rows shuffle, on (digest, salt),
to be grouped exactly. False positives of the filter cost a shuffled row, never a wrong result.

Defined cases
-------------
* null text: counts as empty text; all null and empty texts form one group.
* texts are equal when identical after lower-casing A-Z only (other letters keep their case).
* of equal texts the row with the largest id stays; rows that repeat this id (same text, same id)
  all stay; a null id never beats another id, and a group with null ids only keeps its rows.
* empty table: empty result with the same columns.
* extra columns are passed through; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators.skew import attach
from credence.llm._scratch import materialize

PAGE_BITS = 32768  # bits of one bitmap of bitmap_construct_agg
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28  # 32 MB: the bound of the broadcast filter

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is the same, and faster, on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _cells(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def _bit(bitmap: Column, cell: Column) -> Column:
    at = F.pmod(cell, F.lit(PAGE_BITS))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.shiftright(byte, 0) / F.pow(F.lit(2), F.pmod(at, F.lit(8)))).cast("int").bitwiseAND(1) == 1, F.lit(False))


def repeated_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(page, bitmap) rows of the cells that two or more rows hit."""
    hit = (
        keys.select(F.explode(F.array(*_cells(F.col(key), bits))).alias("cell"))
        .groupBy("cell").count().filter("count > 1")
    )
    page = F.floor(F.col("cell") / PAGE_BITS).alias("page")
    return hit.groupBy(page).agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(PAGE_BITS))).alias("bitmap"))


def possibly_repeated(rows: DataFrame, pages: DataFrame, key: str, bits: int) -> DataFrame:
    """``rows`` plus boolean ``__maybe``. ``pages`` is broadcast: at most ``bits`` / 8 bytes."""
    out = rows
    for i, cell in enumerate(_cells(F.col(key), bits)):
        one = F.broadcast(pages.select(F.col("page").alias(f"__page{i}"), F.col("bitmap").alias(f"__bitmap{i}")))
        out = out.withColumn(f"__page{i}", F.floor(cell / PAGE_BITS)).join(one, f"__page{i}", "left")
        out = out.withColumn(f"__hit{i}", _bit(F.col(f"__bitmap{i}"), cell)).drop(f"__bitmap{i}", f"__page{i}")
    return out.withColumn("__maybe", F.col("__hit0") & F.col("__hit1")).drop("__hit0", "__hit1")


def filter_bits(n_rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_FILTER_BITS) -> int:
    """A power of two of at least ``bits_per_row`` bits a row, up to ``max_bits``. Beyond that the
    filter fills up and more rows shuffle; the result is the same."""
    bits = PAGE_BITS
    while bits < n_rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def annotate(rows: DataFrame, keys: DataFrame, id_col: str = "doc_id", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``rows`` (with column ``__digest``) plus keep_id, group_size, kept. ``keys`` holds id and
    ``__digest`` of the same rows, materialised and narrow: both passes over it are cheap."""
    bits = filter_bits(keys.count(), max_bits=max_bits)
    pages = materialize(repeated_filter(keys, "__digest", bits), "bloom")
    maybe = F.col("__maybe")
    probed = possibly_repeated(rows, pages, "__digest", bits)
    repeated = attach(
        probed.filter(maybe).drop("__maybe"),
        ["__digest"],
        F.col(id_col),
        {"__max": F.max(id_col), "__n": F.count(F.lit(1))},
        {"keep_id": F.max("__max"), "group_size": F.sum("__n")},
        source=possibly_repeated(keys, pages, "__digest", bits).filter(maybe).select("__digest", id_col),
    )
    single = probed.filter(~maybe).drop("__maybe").withColumns(
        {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")}
    )
    return single.unionByName(repeated).withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256."""
    clash = [c for c in ("keep_id", "group_size", "kept", "text_sha256") if c in docs.columns]
    rows = docs.drop(*clash).withColumn("__digest", digest(F.col(text_col)))
    keys = materialize(rows.select(id_col, "__digest"), "digests")
    return annotate(rows, keys, id_col, max_bits).withColumnRenamed("__digest", "text_sha256")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row; texts are read once and never shuffle."""
    keys = materialize(docs.select(id_col, digest(F.col(text_col)).alias("__digest")), "digests")
    out = annotate(keys, keys, id_col)
    return out.select(id_col, "keep_id", "group_size", "kept", F.col("__digest").alias("text_sha256"))
