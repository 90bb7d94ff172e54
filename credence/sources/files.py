"""CSV and JSONL sources/sinks with explicit schemas and a file-order row position.

* All-string CSV scan with the pandas default missing-value tokens mapped to NULL.
* Review file discovery: ``reviews*.csv`` in a folder, else every ``*.csv``; files are
  read in lexicographic order, which (with the in-file row number) defines ``pos``.
* JSONL scan (strict: FAILFAST; lenient: blank lines skipped), optional row cap.
* JSONL sink keeping NULL fields, UTF-8 unescaped.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import LongType, StringType, StructField, StructType

from credence.operators.skew import require_key

# Cell texts that pandas reads as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

POS_STRIDE = 1 << 40  # pos = file_index * stride + row number inside the file


def normalise_na(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.select(*[
        F.when(F.col(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) if c in cols
        else F.col(c) for c in df.columns
    ])


def _csv_reader(spark: SparkSession, multi_line: bool = True, glob_filter: str | None = None):
    r = (spark.read.option("header", "true").option("inferSchema", "false").option("multiLine", str(multi_line).lower())
         .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("encoding", "UTF-8"))
    return r.option("pathGlobFilter", glob_filter) if glob_filter else r


def with_file_position(df: DataFrame, file_col: str = "__file", block_col: str = "__block",
                       out_col: str = "pos") -> DataFrame:
    """``pos`` = rank of the file path * POS_STRIDE + row number inside the file.

    Rows of one block of a file are read by one task in order, so
    ``monotonically_increasing_id`` minus the block's smallest id is the row number in the
    block; the rows of the file's earlier blocks are added. The block table has one row per
    scan split and is joined without a hint."""
    tagged = df.withColumn("__mid", F.monotonically_increasing_id())
    blocks = tagged.groupBy(file_col, block_col).agg(F.min("__mid").alias("__m0"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(file_col).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    names = blocks.select(file_col).distinct().withColumn("__fi", F.row_number().over(Window.orderBy(file_col)) - 1)
    blocks = blocks.join(names, file_col).drop("__n")
    pos = F.col("__fi") * F.lit(POS_STRIDE) + F.col("__before") + (F.col("__mid") - F.col("__m0"))
    return (tagged.join(blocks, [file_col, block_col]).withColumn(out_col, pos)
            .drop("__mid", "__m0", "__fi", "__before", file_col, block_col))


def _place() -> list:
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]


def _by_header(spark: SparkSession, paths, glob_filter: str | None) -> dict[str, list[str]]:
    """Header line -> files that start with it (one small row per file reaches the driver)."""
    r = spark.read.option("pathGlobFilter", glob_filter) if glob_filter else spark.read
    lines = r.text(paths).select("value", *_place()).filter("__block = 0").withColumn("__mid", F.monotonically_increasing_id())
    first = lines.groupBy("__file").agg(F.min_by("value", "__mid").alias("header"))
    out: dict[str, list[str]] = {}
    for row in first.orderBy("__file").collect():
        out.setdefault(row["header"], []).append(row["__file"])
    return out


def read_csv_table(spark: SparkSession, paths, glob_filter: str | None = None,
                   columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """All-string CSV scan (files in path order) with NA normalisation and ``pos``.

    Every file is read by its own header: files with equal headers are scanned together, and
    columns that a file lacks are NULL. ``multi_line=False`` lets large files without line
    breaks in cells be split."""
    raw = None
    for files_of in _by_header(spark, paths, glob_filter).values():
        part = _csv_reader(spark, multi_line).csv([unquote(f) for f in files_of])
        part = part.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in part.columns], *_place())
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    if raw is None:  # no file matches
        raw = _csv_reader(spark, multi_line, glob_filter).csv(paths)
        raw = raw.select(*raw.columns, *_place())
    data_cols = [c for c in raw.columns if c not in ("__file", "__block")]
    out = normalise_na(with_file_position(raw), data_cols)
    for c in columns or []:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def read_reviews_csv(spark: SparkSession, input_dir: str) -> DataFrame:
    """``reviews*.csv`` files of a folder in name order; when there are none, every ``*.csv``."""
    try:
        return read_csv_table(spark, input_dir, "reviews*.csv")
    except AnalysisException:
        return read_csv_table(spark, input_dir, "*.csv")


def read_products_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Product table, or None when the path does not exist (no summaries, not an error)."""
    try:
        return read_csv_table(spark, path, "*.csv")
    except AnalysisException:
        return None


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""').csv(path))


def read_jsonl(spark: SparkSession, path: str, schema: StructType,
               max_rows: int | None = None, cap_is_truthy: bool = True, pos_col: str | None = None) -> DataFrame:
    """JSONL scan with an explicit schema.

    A malformed line fails the read; blank lines are skipped.
    ``pos_col`` adds the row position: the one in the data when every row has it, else the
    file order. ``max_rows`` caps the rows in position order: with ``cap_is_truthy`` a cap of
    0 means no cap, otherwise 0 means no rows."""
    capped = max_rows is not None and not (cap_is_truthy and not max_rows)
    if capped and pos_col is None:
        pos_col = "pos"
    mode = "FAILFAST"
    if pos_col is None:
        return spark.read.schema(schema).option("mode", mode).json(path)
    wide = StructType([f for f in schema.fields if f.name != pos_col] + [StructField(pos_col, LongType(), True)])
    df = spark.read.schema(wide).option("mode", mode).json(path)
    if not df.filter(F.col(pos_col).isNull()).isEmpty():
        df = with_file_position(df.drop(pos_col).select("*", *_place()), out_col=pos_col)
    return limit_prefix(df, max_rows, pos_col) if capped else df


_PREFIX_BUCKETS = 4096


def prefix_end(df: DataFrame, n: int, pos: str = "pos") -> int | None:
    """The position of the ``n``-th row, or None when there are no more than ``n``. Counts over ranges of
    positions, each pass inside the range that holds the n-th row: at most ``_PREFIX_BUCKETS`` rows reach
    the driver per pass, and only the position column is read."""
    only = require_key(df.select(pos), pos)
    whole = only.agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if whole["n"] <= n:
        return None
    lo, hi, left = int(whole["lo"]), int(whole["hi"]), n
    while lo < hi:
        width = -(-(hi - lo + 1) // _PREFIX_BUCKETS)
        inside = only.filter(F.col(pos).between(lo, hi))
        counts = inside.groupBy(F.expr(f"(`{pos}` - {lo}L) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(counts.collect(), key=lambda r: r["b"]):
            if left <= r["n"]:
                lo, hi = lo + int(r["b"]) * width, min(hi, lo + (int(r["b"]) + 1) * width - 1)
                break
            left -= r["n"]
    return lo


def limit_prefix(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` rows in position order (``pos`` unique, not NULL): a filter on the n-th row's
    position, which is pushed to the scan where ``pos`` is stored. No row is ranked or shuffled."""
    if n <= 0:
        return df.limit(0)
    end = prefix_end(df, n, pos)
    return df if end is None else df.filter(F.col(pos) <= end)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; NULL fields kept as ``null``; parents created."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("encoding", "UTF-8").json(path)


def derived_paths(output: str) -> tuple[str, str]:
    """``<stem>_train.jsonl`` and ``<stem>_test.jsonl`` next to ``output``."""
    base, _ = os.path.splitext(output)
    return f"{base}_train.jsonl", f"{base}_test.jsonl"


__all__ = ["NA_TOKENS", "normalise_na", "with_file_position", "read_csv_table", "read_reviews_csv",
           "read_products_csv", "write_csv", "read_jsonl", "limit_prefix", "write_jsonl", "derived_paths"]
