"""Streaming duplicate flags keep state across micro-batches."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from credence.streaming import scoring


def _write(path, rows):
    with open(path, "w") as f:
        f.write("review_id,review_text\n")
        for rid, text in rows:
            f.write(f'{rid},"{text}"\n')


def test_duplicates_across_micro_batches(spark):
    src = tempfile.mkdtemp(prefix="credence-stream-in-")
    _write(os.path.join(src, "a.csv"), [("1", "same words"), ("2", "other"), ("3", "same words")])
    now = time.time()
    os.utime(os.path.join(src, "a.csv"), (now - 100, now - 100))
    _write(os.path.join(src, "b.csv"), [("4", "same words"), ("5", "new one"), ("6", "other")])
    stream = scoring.read_review_stream(spark, src, ["review_id", "review_text"], max_files_per_trigger=1)
    stream = stream.withColumn("ts", F.timestamp_seconds(F.col("review_id").cast("long") + 1_600_000_000))
    flags = scoring.flag_duplicates_stream(stream, "review_text", "review_id", "ts", "review_id", delay="3650 days")
    out = tempfile.mkdtemp(prefix="credence-stream-out-")
    q = scoring.start_file_sink(flags, out + "/data", out + "/ckpt")
    q.awaitTermination()
    got = {r.row_key: r.is_duplicate for r in spark.read.parquet(out + "/data").collect()}
    assert got == {"1": False, "2": False, "3": True, "4": True, "5": False, "6": True}
    assert len(q.recentProgress) >= 2  # two micro-batches: the state carried across them


def test_drop_duplicates_stream(spark):
    src = tempfile.mkdtemp(prefix="credence-stream-drop-")
    _write(os.path.join(src, "a.csv"), [("1", "same words"), ("2", "other"), ("3", "same words")])
    stream = scoring.read_review_stream(spark, src, ["review_id", "review_text"])
    stream = stream.withColumn("ts", F.timestamp_seconds(F.col("review_id").cast("long") + 1_600_000_000))
    cleaned = scoring.drop_duplicates_stream(stream, "review_text", "ts", "3650 days")
    out = tempfile.mkdtemp(prefix="credence-stream-drop-out-")
    q = scoring.start_file_sink(cleaned.select("review_id", "review_text"), out + "/data", out + "/ckpt")
    q.awaitTermination()
    got = sorted(r.review_text for r in spark.read.parquet(out + "/data").collect())
    assert got == ["other", "same words"]


def test_duplicate_flags_with_a_hot_text(spark):
    """A third of all rows hold one text; several micro-batches equal the batch flags, also when the last
    micro-batch is repeated."""
    from credence.operators import labeling

    src, out = tempfile.mkdtemp(prefix="credence-stream-hot-"), tempfile.mkdtemp(prefix="credence-stream-hot-out-")
    rows = [(str(i), "hot words" if i % 3 == 0 else f"text {i % 200}") for i in range(900)]
    now = time.time()
    for part in range(4):
        name = os.path.join(src, f"p{part}.csv")
        _write(name, rows[part * 225 : (part + 1) * 225])
        os.utime(name, (now - 100 + part, now - 100 + part))

    def run(checkpoint):
        stream = scoring.read_review_stream(spark, src, ["review_id", "review_text"], max_files_per_trigger=1)
        q = scoring.start_duplicate_flags(stream, out + "/data", out + checkpoint, "review_text", "review_id", "review_id")
        q.awaitTermination()
        return len(q.recentProgress), {r.row_key: r.is_duplicate for r in spark.read.parquet(out + "/data/flags").collect()}

    batch = spark.createDataFrame([(int(i), i, t) for i, t in rows], "pos long, review_id string, review_text string")
    want = {r.review_id: r.is_duplicate for r in labeling.flag_duplicates(batch, "review_text").collect()}
    progress, got = run("/first")
    assert progress >= 4 and got == want
    _, again = run("/second")  # all micro-batches once more, as after a lost checkpoint
    assert again == want


def test_file_sink_transforms_micro_batches_as_batch_tables(spark):
    """Sorts and windows of the batch plans work on each micro-batch; a repeated run replaces its folders."""
    src, out = tempfile.mkdtemp(prefix="credence-stream-each-"), tempfile.mkdtemp(prefix="credence-stream-each-out-")
    now = time.time()
    for part in range(2):
        _write(os.path.join(src, f"p{part}.csv"), [(str(part * 3 + i), "t") for i in range(3)])
        os.utime(os.path.join(src, f"p{part}.csv"), (now - 100 + part, now - 100 + part))
    for checkpoint in ("/first", "/second"):
        stream = scoring.read_review_stream(spark, src, ["review_id", "review_text"], max_files_per_trigger=1)
        q = scoring.start_file_sink(stream, out + "/data", out + checkpoint, each=lambda b: (
            b.sortWithinPartitions("review_id") if not b.isStreaming else b.limit(0)).select("review_id"))
        q.awaitTermination()
        got = spark.read.parquet(out + "/data")
        assert sorted((r.batch, r.review_id) for r in got.collect()) == [(i // 3, str(i)) for i in range(6)]


def test_arriving_files_have_bounded_rows(spark, monkeypatch):
    """More rows are more files, not larger ones; still three micro-batches and the batch flags."""
    from credence.operators import labeling
    from credence.plans import catalog

    where = tempfile.mkdtemp(prefix="credence-arriving-")
    spark.range(90).selectExpr("id AS doc_id", "concat('text ', id % 40) AS text").write.parquet(where + "/documents.parquet")
    written = []
    monkeypatch.setattr(catalog, "ARRIVING_FILE_ROWS", 5, raising=False)
    monkeypatch.setattr(catalog, "_write_ordered_csv", lambda df, path, parts=None, f=catalog._write_ordered_csv: written.append(parts) or f(df, path, parts))
    got = {r.review_id: r.is_duplicate for r in catalog.q_stream_flag_duplicates(spark, where).collect()}
    reviews = catalog.testdata.reviews(spark, where)
    assert got == {r.review_id: r.is_duplicate for r in labeling.flag_duplicates(reviews, "review_text").collect()}
    assert written == [6, 6, 6]
