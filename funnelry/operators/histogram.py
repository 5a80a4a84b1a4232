"""Bucketed counts (AGG-5, AGG-6, AGG-9, ORD-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.functions.numbers import bucket_label


def histogram(
    df: DataFrame,
    value: str,
    table: Sequence[tuple[int | None, str]],
    label: str,
    count: str,
    weight: Column | None = None,
) -> DataFrame:
    """Rows per bucket (or their summed weight), ordered by the smallest value in the bucket.

    There are as many rows as buckets at most; saying so makes the order a top-k, not a range
    sort with a sampling job of its own.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.groupBy(bucket_label(F.col(value), table).alias(label))
        .agg(F.min(value).alias("sort_key"), size.alias(count))
        .orderBy("sort_key")
        .limit(len(table))
    )


def session_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy("user_session").agg(F.count(F.lit(1)).alias("n_events"))


def session_spans(events: DataFrame) -> DataFrame:
    span = F.max("event_ts") - F.min("event_ts")
    return events.groupBy("user_session").agg(span.alias("duration_sec"))
