"""Token-id files: flat unsigned integers plus 64-bit document offsets, read memory-mapped.

Documents are range-partitioned by id; each task encodes its part in id order and writes three flat
little-endian files (written under a temporary name, then renamed, so a repeated task leaves the
same files): ``part-N.ids`` (the smallest unsigned type that holds the vocabulary), ``part-N.off``
(int64: document offsets inside the part, one more than documents) and ``part-N.doc`` (int64 ids).
A manifest (one row per part) holds the parts' bases in the whole sequence, which are prefix sums
of the parts' counts.

Defined cases
-------------
* null text: empty; a document without tokens still gets the end id. Null id: written as
  ``NULL_ID`` and read back as null, before all others. Rows of one id stay apart, in text order.
* empty table: no files, an empty manifest and an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm import _encode, _text

NULL_ID = -(2**63)
READ_IDS = 4_000_000  # ids in one batch read back, at least one document


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _dtype(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the files under ``path`` (a folder all workers share) and returns the manifest:
    part, n_docs, n_tokens, width (bytes of an id), start (ids before the part), doc_start."""
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encode.encoder(tokenizer)
        kind = _dtype(max(enc.size, end_id + 1))
        part = TaskContext.get().partitionId()
        out = None
        lengths, ids_of = [], []
        for batch in _text.chunks(batches):
            if out is None:
                fs, root = _open(path)
                fs.create_dir(root, recursive=True)
                temp = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{temp}.ids")
            data, offsets = _text.utf8(batch.column(1))
            ids, first = enc.encode(data, offsets)
            out.write(np.insert(ids, first[1:], end_id).astype(kind).tobytes())
            lengths.append(np.diff(first) + 1)
            ids_of.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        n = np.concatenate(lengths)
        sides = {"off": np.concatenate([[0], np.cumsum(n)]).astype("<i8"), "doc": np.concatenate(ids_of)}
        for name, values in sides.items():
            with fs.open_output_stream(f"{temp}.{name}") as f:
                f.write(values.tobytes())
        for name in ("ids", *sides):
            fs.move(f"{temp}.{name}", f"{root}/part-{part:06d}.{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(n)], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64()), "width": pa.array([kind.itemsize], pa.int32())})

    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = placed.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    placed.mapInArrow(write, "part int, n_docs long, n_tokens long, width int").write.parquet(f"{path}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    manifest = spark.read.parquet(f"{path}/parts").withColumns({
        "start": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)),
        "doc_start": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
    })
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _mapped(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    """The file's bytes: mapped where the file system is local, else read."""
    with (pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)) as f:
        return f.read_buffer()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = _open(path)
                name = f"{root}/part-{row['part']:06d}"
                ids = np.frombuffer(_mapped(fs, f"{name}.ids"), f"<u{row['width']}")
                off = np.frombuffer(_mapped(fs, f"{name}.off"), "<i8")
                doc = np.frombuffer(_mapped(fs, f"{name}.doc"), "<i8")
                at = 0
                while at < len(doc):
                    to = max(at + 1, int(np.searchsorted(off, off[at] + READ_IDS, "right")) - 1)
                    body = ids[off[at] : off[to]].astype("<u4").tobytes()
                    ends = ((off[at : to + 1] - off[at]) * 4).astype(np.int32 if len(body) < 2**31 else np.int64)
                    kind = pa.binary() if ends.dtype == np.int32 else pa.large_binary()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc[at:to], mask=doc[at:to] == NULL_ID),
                        pa.array(off[at:to] + row["start"]),
                        pa.array(np.diff(off[at : to + 1])),
                        pa.Array.from_buffers(kind, to - at, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)]).cast(pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    at = to

    manifest = spark.read.parquet(f"{path}/manifest")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("part", "width", "start").repartitionByRange(parts, "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")
