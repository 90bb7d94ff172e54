"""Structured Streaming: label review files as they arrive.

Every step of the labelling path is stateless per review (stream-static join to the
product summaries, embedding, top-k against the static product collection, rules), so
the batch transforms run unchanged on a streaming DataFrame. Output goes to a file sink
with a checkpoint (exactly-once; a restarted query resumes where it stopped).

Duplicate flagging needs state. ``start_duplicate_flags`` keeps it as a table and combines each
micro-batch in two salted levels, so a hot text meets in no single task. ``flag_duplicates_stream``
keeps, per text hash, whether the text was seen (``applyInPandasWithState``); its state expires with
the event-time watermark, but the rows of one text in a micro-batch meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from credence.functions.text import content_hash
from credence.operators import labeling, records
from credence.operators.retrieval import Packed
from credence.operators.skew import attach
from credence.schemas import REVIEW_COLUMNS


def read_review_stream(spark: SparkSession, input_dir: str, columns: list[str] | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Review CSV files arriving in ``input_dir`` (all-string, NA tokens -> NULL).

    A streaming CSV source applies its schema by position, so ``columns`` must list the
    files' header in order (default: the standard review export columns)."""
    from credence.sources.files import normalise_na

    schema = StructType([StructField(c, StringType(), True) for c in (columns or REVIEW_COLUMNS)])
    r = (spark.readStream.schema(schema).option("header", "true").option("multiLine", "true")
         .option("quote", '"').option("escape", '"').option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.csv(input_dir)
    return normalise_na(df, [f.name for f in schema.fields])


def label_review_stream(reviews: DataFrame, products: DataFrame | None, collection: DataFrame | Packed, k: int = 3,
                        **label_kw) -> DataFrame:
    """Labelled records of a stream, or of one micro-batch (``start_file_sink(each=...)``: a large
    collection needs that, since a stream meets it block after block in joined rows). Micro-batches
    can share a collection that is packed once (``retrieval.pack_collection``)."""
    recs = records.review_records(reviews.withColumn("pos", F.lit(None).cast("long")), products)
    return labeling.label_reviews(recs, collection, k=k, **label_kw)


def start_file_sink(df: DataFrame, path: str, checkpoint: str, available_now: bool = True, fmt: str = "parquet",
                    each: Callable[[DataFrame], DataFrame] | None = None):
    """Append to a file sink with a checkpoint (exactly-once). ``each`` transforms every micro-batch as a
    batch table, with the batch plans' sorts and adaptive joins; its rows go to ``<path>/batch=<id>``,
    and a micro-batch that is repeated after a failure replaces its own folder."""
    if each is not None:
        def one(batch: DataFrame, batch_id: int) -> None:
            each(batch).write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

        w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


_DUP_OUT = StructType([
    StructField("__h", StringType()), StructField("row_key", StringType()), StructField("is_duplicate", BooleanType()),
])
_DUP_STATE = StructType([StructField("first_order", LongType())])


def _dup_state_fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    # Only (order, row key, event time) of this text's rows in this micro-batch are held;
    # a micro-batch is bounded by the source's maxFilesPerTrigger / maxBytesPerTrigger.
    parts = [pdf[["__order", "row_key", "__ts"]] for pdf in batches]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    first = state.get[0] if state.exists else int(rows["__order"].min())
    yield pd.DataFrame({"__h": key[0], "row_key": rows["row_key"], "is_duplicate": rows["__order"] != first})
    latest = int(pd.to_datetime(rows["__ts"]).max().value // 1_000_000)
    state.update((first,))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)


def flag_duplicates_stream(df: DataFrame, col: str, order_col: str, event_time: str, key_col: str,
                           delay: str = "1 day") -> DataFrame:
    """Streaming duplicate flags: ``key_col, is_duplicate`` per row. The first copy of a text
    (smallest ``order_col``) is not a duplicate; later copies are, across micro-batches,
    while the text's state lives (until the watermark passes)."""
    keyed = (df.withWatermark(event_time, delay)
             .select(content_hash(F.col(col)).alias("__h"), F.col(key_col).cast("string").alias("row_key"),
                     F.col(order_col).cast("long").alias("__order"), F.col(event_time).alias("__ts")))
    flags = keyed.groupBy("__h").applyInPandasWithState(
        _dup_state_fn, _DUP_OUT, _DUP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return flags.select(F.col("row_key"), F.col("is_duplicate"))


def start_duplicate_flags(df: DataFrame, path: str, checkpoint: str, col: str, order_col: str, key_col: str,
                          available_now: bool = True):
    """Streaming duplicate flags whose state is a table: ``<path>/flags`` gets ``row_key, is_duplicate``
    per row, ``<path>/state`` the first order of each text, both in one folder per micro-batch.

    First orders are combined in two levels, per (text, salt) before the shuffle's reduce side and then
    per text, and are joined back per (text, salt): a text with a third of all rows is spread over
    ``skew.SALTS`` tasks, and no task holds a text's rows. The state meets the per-text minima (one row
    per text of the micro-batch), not the rows. A micro-batch that is repeated after a failure replaces
    its own folders and reads the states of earlier ones, so the result is the same (exactly once).
    The first copy within a micro-batch is the one with the smallest ``order_col``; a text seen in an
    earlier micro-batch has no first copy any more. The state keeps every text."""

    def state_before(spark: SparkSession, batch_id: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/state").where(F.col("batch") < batch_id).select("__h", "seen")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def one(batch: DataFrame, batch_id: int) -> None:
        state = state_before(batch.sparkSession, batch_id)
        rows = batch.select(content_hash(F.col(col)).alias("__h"), F.col(key_col).cast("string").alias("row_key"),
                            F.col(order_col).cast("long").alias("__order"))

        def known(firsts: DataFrame) -> DataFrame:
            if state is None:
                return firsts.withColumn("seen", F.lit(None).cast("boolean"))
            return firsts.join(state, "__h", "left")

        flagged = attach(rows, ["__h"], F.col("row_key"), {"__m": F.min("__order")}, {"__first": F.min("__m")}, then=known)
        flags = flagged.select("row_key", (F.col("seen").isNotNull() | (F.col("__order") != F.col("__first"))).alias("is_duplicate"))
        flags.write.mode("overwrite").parquet(f"{path}/flags/batch={batch_id}")
        new = rows.select("__h").distinct().withColumn("seen", F.lit(True))
        if state is not None:
            new = new.join(state.select("__h"), "__h", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def drop_duplicates_stream(df: DataFrame, col: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """Streaming "cleaned" output: one copy of each text within the watermark is kept
    (Spark's built-in ``dropDuplicatesWithinWatermark`` on the text hash; state expires
    with the watermark). The copy kept is the first to *arrive*, not the first by file
    position; ``flag_duplicates_stream`` gives position-exact flags."""
    keyed = df.withWatermark(event_time, delay).withColumn("__h", content_hash(F.col(col)))
    return keyed.dropDuplicatesWithinWatermark(["__h"]).drop("__h")
