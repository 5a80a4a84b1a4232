"""Reports for a set of users, the cohort (JOIN-1).

`restricted` keeps the events of a cohort, for any report; `with_membership` marks them. Both are
joins on the user alone: a small cohort is sent to the executors, a large one is shuffled, where AQE
splits the rows of a user with very many. Between the two, Spark may send a Bloom filter of the
cohort to the scan of the events (`spark.sql.optimizer.runtime.bloomFilter.enabled`, on by default,
for scans from its `applicationSideScanSizeThreshold` on), so that most other rows never reach the
shuffle. A missing user is in no cohort; how often a cohort names a user does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restricted(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """The events of the cohort's users; `cohort` has a column user_id."""
    members = cohort.select(F.col("user_id").alias("_member"))
    return events.join(members, F.col("user_id") == F.col("_member"), "left_semi")


def with_membership(events: DataFrame, cohort: DataFrame, name: str = "in_cohort") -> DataFrame:
    """Every event with whether its user is in the cohort: never NULL, no event lost or repeated."""
    query = (
        f"SELECT *, EXISTS (SELECT 1 FROM {{cohort}} AS c WHERE c.user_id = e.user_id) AS `{name}`"
        " FROM {events} AS e"
    )
    return events.sparkSession.sql(query, events=events, cohort=cohort.select("user_id"))


def buyers_since(events: DataFrame, kind: str, second: int) -> DataFrame:
    """The users with an event of this kind from a time on."""
    chosen = (F.col("event_type") == kind) & (F.col("event_ts") >= second)
    return events.where(chosen).select("user_id").distinct()
