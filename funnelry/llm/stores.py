"""Tables written between the steps of an operator, and columns picked by their exact names.

Intermediate tables go to the folder that the cluster shares, `spark.checkpoint.dir`, so that a lost
executor never takes the only copy with it. They live in one folder per application, which may be
deleted when the application has ended.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelry.sources.shared import shared_root

#: Rows of a side that is sent to every executor. It holds a few long integers a row.
MAX_BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; a local folder only where this machine is the only one."""
    found = shared_root(spark)
    if found is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for one write; names are given with `__` for each dot."""
    wanted = {name.replace("__", "."): value for name, value in wanted.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written to the shared folder and read again; cuts the lineage.

    The shuffle files of the write are given back at its end.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with settings(
        spark,
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
        spark__sql__parquet__compression__codec="zstd",
    ):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 64) -> None:
    """Bounds the rows that are handed to Python at once, for very long texts and packed rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by their exact names, under new ones: pick(df, id="doc_id", text="text").

    Other columns are left out whatever they are called, also where a name occurs in other cases.
    """
    place = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    numbered = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return numbered.select(*(F.col(f"_{place[old]}").alias(new) for new, old in columns.items()))


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is not among `ids`, a frame of one column; NULL keys stay.

    A short list of ids is sent to the executors; a longer one is joined by a shuffle.
    """
    if ids.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    place = df.columns.index(key)
    own = [f"_{i}" for i in range(len(df.columns))]
    numbered, gone = df.toDF(*own), ids.toDF("_gone")
    left = numbered.join(gone, F.col(own[place]) == F.col("_gone"), "left_anti")
    return left.toDF(*df.columns)
