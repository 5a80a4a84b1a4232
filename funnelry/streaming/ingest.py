"""The load in steps: new raw files into the stored table, each exactly once.

Sampling, time parsing and filtering are plain column expressions, so they run on a stream
unchanged and hold no state. Progress lives in a checkpoint on shared storage; after a crash the
next run goes on with the first batch that was not finished. A batch is written to a folder of its
own below the table and replaces it if it is run again, so a batch counts once, and the table may
also hold rows of `event_table.write_events` and of other streams.

Beside each batch stands how many rows it brought and how many users that no batch before it had.
Users are known from the state of the stream, first and last time seen of each, kept in its
checkpoint; a user's rows are combined in each task before they reach the state, so a user on a third
of all rows is one row per task there. A large table wants the RocksDB state store,
`spark.sql.streaming.stateStore.providerClass`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from funnelry.functions.sampling import sample_users
from funnelry.schema import EVENT_COLUMNS, RAW_COLUMNS
from funnelry.sources.csv_events import CSV_OPTIONS, blank_to_null, file_schema, normalise
from funnelry.sources.shared import found_files


def stream_events(
    spark: SparkSession, source: str, keep_buckets: int, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of event rows of the kept users. `source` is a folder of files with one header;
    a file with another one stops the stream."""
    reader = spark.readStream.options(**CSV_OPTIONS).schema(file_schema(spark, source))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = blank_to_null(reader.csv(source).select(*RAW_COLUMNS))
    return normalise(sample_users(raw, keep_buckets))


def stream_name(source: str, path: str) -> str:
    """A name for the way from one source to one table that is right for any file system."""
    ends = (end.rstrip("/") for end in (source, path))
    return hashlib.sha256("\n".join(ends).encode()).hexdigest()[:32]


def with_new_users(stream: DataFrame) -> DataFrame:
    """The events and, in the same batch, a row for each of its users: `_new` if never seen before.

    `_new` is NULL on events. A user is new if first and last seen in the same batch; the time of a
    batch is part of its record and the same again when the batch is repeated.
    """
    seen = stream.select("user_id", F.current_timestamp().alias("seen"))
    users = seen.groupBy("user_id").agg(F.min("seen").alias("first"), F.max("seen").alias("last"))
    users = users.select("user_id", (F.col("first") == F.col("last")).alias("_new"))
    return stream.select(*EVENT_COLUMNS).unionByName(users, allowMissingColumns=True)


def append_events(
    stream: DataFrame, source: str, path: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Appends everything that has arrived from `source` to the table at `path`, then stops.

    The checkpoint defaults to a folder under the session's `spark.checkpoint.dir`, one for each
    pair of source and table. `load_progress` tells what each batch has brought.
    """
    name = stream_name(source, path)
    if checkpoint is None:
        root = stream.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None:
            raise ValueError("set spark.checkpoint.dir or pass a checkpoint folder")
        checkpoint = f"{root.rstrip('/')}/append_events/{name}"
    root = path.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        counted = Observation(f"batch-{number}")
        events = F.count_if(F.col("_new").isNull()).alias("events")
        rows = batch.observe(counted, events, F.count_if("_new").alias("users"))
        rows = rows.where("_new IS NULL").select(*EVENT_COLUMNS)
        rows.write.mode("overwrite").parquet(f"{root}/stream-{name}/batch-{number:012d}")
        told = [(name, number, counted.get["events"], counted.get["users"])]
        progress = batch.sparkSession.createDataFrame(told, PROGRESS)
        progress.write.mode("overwrite").parquet(f"{root}/progress-{name}/batch-{number:012d}")

    return (
        with_new_users(stream)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


PROGRESS = "stream string, batch bigint, events bigint, users bigint"


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch, events, users, total_events, total_users): the running counts (SRC-12).

    `events` and `users` are the rows of a batch and its users that the stream had not met before,
    the totals those of all batches so far. One row for each batch.
    """
    found = found_files(spark, f"{path.rstrip('/')}/progress-*/batch-*")
    if not found:
        batches = spark.createDataFrame([], PROGRESS)
    else:
        batches = spark.read.schema(PROGRESS).parquet(*(p for p, *_ in found))
    so_far = Window.partitionBy("stream").orderBy("batch")
    totals = {f"total_{c}": F.sum(c).over(so_far) for c in ("events", "users")}
    return batches.withColumns(totals)
