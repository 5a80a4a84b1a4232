"""Stored forms of the event table for reports by user and for samples of users (SRC-3, SRC-11, AGG-1).

`save_user_buckets` stores the table in buckets by user, each sorted, so that whatever is grouped by
user needs no exchange. A bucket is read by one task, so users with more rows than a bucket should
hold are stored apart, laid out over many files, and grouped with partial sums. As no user is in both
parts, what is computed per user in each of them is simply put together.

`write_for_samples` stores the bucket that decides whether a user is sampled beside each event and
orders the files by it. A sample is then a range of that column: files and row groups beyond it are
not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.functions.sampling import user_bucket
from funnelry.schema import EVENT_COLUMNS, EVENT_SCHEMA
from funnelry.sources.event_table import clustered

BUCKET = "user_bucket"
SAMPLE_SCHEMA = T.StructType([*EVENT_SCHEMA, T.StructField(BUCKET, T.IntegerType())])


@dataclass(frozen=True)
class UserBuckets:
    """The table in two parts that share no user: buckets, and the users that fill one alone."""

    even: DataFrame
    hot: DataFrame

    def per_user(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What `f` computes per user: without an exchange for all users but the hot ones."""
        return f(self.even).unionByName(f(self.hot))


def hot_users(events: DataFrame, buckets: int) -> DataFrame:
    """Users with more rows than a bucket has on average; fewer of them than buckets.

    Rows without a user count as one user.
    """
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    mean = F.lit(events.count() / buckets)
    found = counts.where(F.col("rows") > F.greatest(mean, F.lit(1))).select("user_id")
    return events.sparkSession.createDataFrame(found.collect(), found.schema)


def save_user_buckets(
    events: DataFrame, table: str, buckets: int, path: str | None = None
) -> None:
    """Replaces the catalogue tables `table` and `table`_hot; files go below `path`, if given.

    One shuffle by user deals the rows out as the buckets need them, so that each is one file.
    """
    hot = F.broadcast(hot_users(events, buckets).withColumnRenamed("user_id", "_hot"))
    rows = events.select(*EVENT_COLUMNS)
    same = F.col("user_id").eqNullSafe(F.col("_hot"))
    even = rows.join(hot, same, "left_anti").repartition(buckets, "user_id")
    parts = {
        table: even.write.bucketBy(buckets, "user_id").sortBy("user_id", "event_ts"),
        f"{table}_hot": clustered(rows.join(hot, same, "left_semi")).write,
    }
    for name, writer in parts.items():
        if path:
            writer = writer.option("path", f"{path.rstrip('/')}/{name}")
        writer.mode("overwrite").format("parquet").saveAsTable(name)


def read_user_buckets(spark: SparkSession, table: str) -> UserBuckets:
    return UserBuckets(spark.table(table), spark.table(f"{table}_hot"))


def write_for_samples(events: DataFrame, path: str, partitions: int | None = None) -> None:
    """Stores the events with their user's bucket, in ranges of it.

    Ranges go by bucket, user and place in the input, so a user on very many rows is spread over
    files; see `clustered` for what is asked of the input.
    """
    by = [BUCKET, "user_id", "_place"]
    rows = events.select(
        *EVENT_COLUMNS,
        user_bucket().cast("int").alias(BUCKET),
        F.monotonically_increasing_id().alias("_place"),
    )
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *by)
    ranged.sortWithinPartitions(*by).drop("_place").write.mode("overwrite").parquet(path)


def read_sample(spark: SparkSession, path: str, keep_buckets: int) -> DataFrame:
    """The events of the users in the first `keep_buckets` buckets, as `sample_users` keeps them."""
    stored = spark.read.schema(SAMPLE_SCHEMA).parquet(path)
    return stored.where(F.col(BUCKET) < keep_buckets).drop(BUCKET)
