"""The stored event table: versions, writing, layout, statistics, load report (SRC-10..12).

A table is a folder of loads and streamed batches, each a folder of its own that Spark marks with
`_SUCCESS` when all of its files are in place:

    load-<number>-<name>/          a full load; the last one that is marked counts
    stream-<source>/batch-<number>/  batches of the incremental load; all that are marked count

A load therefore becomes visible as a whole or, if it fails, not at all, and it replaces earlier
loads only: what a stream has appended, and its checkpoint counts as done, stays in the table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from funnelry.schema import EVENT_COLUMNS, EVENT_SCHEMA
from funnelry.sources.shared import found_files, remove

DONE = "_SUCCESS"


def _marked(spark: SparkSession, pattern: str) -> list[str]:
    """Finished folders, by name."""
    return [path[: -len(DONE) - 1] for path, *_ in found_files(spark, f"{pattern}/{DONE}")]


def loads(spark: SparkSession, path: str) -> list[str]:
    """The finished loads of a table, the present one last."""
    return _marked(spark, f"{path.rstrip('/')}/load-*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The table with its fixed schema; nothing is inferred, files are not opened for it.

    The finished folders are listed once, here. A folder of Parquet files without any load in it is
    read as it is.
    """
    root = path.rstrip("/")
    parts = loads(spark, root)[-1:] or ([root] if found_files(spark, f"{root}/*.parquet") else [])
    streams = {p.rsplit("/", 1)[0]: None for p in _marked(spark, f"{root}/stream-*/batch-*")}
    reader = spark.read.schema(EVENT_SCHEMA)
    tables = [reader.parquet(p) for p in parts]
    for stream in streams:
        tables.append(reader.parquet(*_marked(spark, f"{stream}/batch-*")))
    if not tables:
        known = found_files(spark, f"{root}/*")
        return spark.createDataFrame([], EVENT_SCHEMA) if known else reader.parquet(root)
    return reduce(DataFrame.unionByName, tables)


def write_events(
    events: DataFrame, path: str, compact: bool = False, keep: int = 1
) -> dict[str, int]:
    """Loads the table anew and returns the load report.

    Until the last file is in place readers see the earlier load, of which `keep` stay for those
    that are still reading it. Streamed batches are left as they are. `events` may be read from the
    same table.

    A scan of very many splits that keeps few users would leave as many tiny files; `compact`
    has AQE gather the kept rows into files of its advisory size first.

    Rows are counted while they are written. The write is the last stage of its job, so a task
    that is run again is counted once. Distinct users are counted over the one stored column.
    """
    spark, root = events.sparkSession, path.rstrip("/")
    before = loads(spark, root)
    number = 1 + max((int(p.rsplit("/load-", 1)[1].split("-")[0]) for p in before), default=0)
    folder = f"{root}/load-{number:012d}-{uuid.uuid4().hex[:8]}"
    seen = Observation("load")
    rows = events.select(*EVENT_COLUMNS)
    if compact:
        rows = rows.hint("rebalance")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("events"))
    rows.write.parquet(folder)
    loaded = spark.read.schema(EVENT_SCHEMA).parquet(folder)
    users = loaded.agg(F.count_distinct("user_id")).first()[0]
    for old in before[: len(before) - keep]:
        remove(spark, old)
    return {"events": seen.get["events"], "users": users}


def load_report(events: DataFrame) -> DataFrame:
    """One row: events and distinct users of a table."""
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")
    )


def clustered(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a user next to each other, in time order.

    Files then cover narrow user ranges: a lookup by user skips most of them, and aggregates by
    user or session collapse almost fully before their shuffle. Ranges over user and time split
    a user with very many events over several files where hashing the user would not; the row's
    place in the input does the same for copies. That place is the same again when a task is
    repeated, as long as `events` is read from files; store the table first, then lay it out.
    Finding the ranges costs one more pass, paid once for all later reads.
    """
    by = ["user_id", "event_ts", "_place"]
    placed = events.withColumn("_place", F.monotonically_increasing_id())
    spread = (
        placed.repartitionByRange(*by)
        if partitions is None
        else placed.repartitionByRange(partitions, *by)
    )
    return spread.sortWithinPartitions(*by).drop("_place")


def save_as_table(events: DataFrame, table: str) -> None:
    """Replaces a catalogue table and computes the statistics its lookup columns need."""
    events.select(*EVENT_COLUMNS).write.mode("overwrite").format("parquet").saveAsTable(table)
    events.sparkSession.sql(
        f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS user_id, user_session, event_type"
    )
