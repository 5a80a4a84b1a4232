"""Time between consecutive events of a user (WIN-2, FLT-2).

A window over raw events would sort all events of one user in one task, whatever their number.
Events in the same second are interchangeable for gaps, so they are counted first: n events in
a second are one gap to the previous second and n - 1 gaps of zero. Seconds are then compared
within a day of a user, so a user who never stops is spread over as many partitions as there are
days, 86,400 rows each at most. The first second of a day is compared with the last one of the
user's previous day with events; that window sees one row per user and day, which a second scan of
the two columns aggregates before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 86_400


def event_gaps(events: DataFrame) -> DataFrame:
    """(user_id, event_ts, gap_sec, gaps): how many events at this second have this gap.

    The gap of a user's very first event does not exist and is left out. Summed over `gaps`
    this is one row per event except each user's first. Events without a time have no gap.
    """
    seconds = (
        events.where(F.col("event_ts").isNotNull())
        .groupBy("user_id", "event_ts")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_slice", F.floor(F.col("event_ts") / SLICE_SECONDS))
    )
    by_time = Window.partitionBy("user_id", "_slice").orderBy("event_ts")
    to_previous = F.col("event_ts") - F.lag("event_ts").over(by_time)

    def gap(seconds: Column, times: Column) -> Column:
        return F.struct(seconds.alias("gap_sec"), times.alias("gaps"))

    after_previous = gap(
        F.col("to_previous"), F.col("to_previous").isNotNull().cast("bigint")
    )
    within_second = gap(F.lit(0).cast("bigint"), F.col("n") - 1)
    within_slices = (
        seconds.withColumn("to_previous", to_previous)
        .select("user_id", "event_ts", F.inline(F.array(after_previous, within_second)))
        .where(F.col("gaps") > 0)
    )
    slices = seconds.groupBy("user_id", "_slice").agg(
        F.min("event_ts").alias("event_ts"), F.max("event_ts").alias("_last")
    )
    by_slice = Window.partitionBy("user_id").orderBy("_slice")
    between_slices = slices.select(
        "user_id",
        "event_ts",
        (F.col("event_ts") - F.lag("_last").over(by_slice)).alias("gap_sec"),
        F.lit(1).cast("bigint").alias("gaps"),
    ).where(F.col("gap_sec").isNotNull())
    return within_slices.unionByName(between_slices)
