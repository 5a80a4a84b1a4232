"""From first view to first purchase (AGG-7, AGG-8, FLT-3, FLT-4, SET-3, JOIN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.fixed_values import CONVERSION_KIND, PURCHASE, SAME_SESSION, VIEW
from funnelry.functions.events import did_any, only_if
from funnelry.functions.numbers import bucket_label

FIRST_VIEW = "first_view_ts"
FIRST_PURCHASE = "first_purchase_ts"


def _firsts() -> list[Column]:
    return [
        F.min(only_if(VIEW, "event_ts")).alias(FIRST_VIEW),
        F.min(only_if(PURCHASE, "event_ts")).alias(FIRST_PURCHASE),
    ]


def first_times(events: DataFrame) -> DataFrame:
    """Every user with the time of the first view and the first purchase, NULL if none."""
    return events.groupBy("user_id").agg(*_firsts())


def converters(events: DataFrame) -> DataFrame:
    """Users whose first purchase is not before their first view, with the delay in seconds.

    Only views and purchases can matter, so the filter goes ahead of the aggregate and down to
    the scan.
    """
    return valid_converters(first_times(events.where(did_any(VIEW, PURCHASE))))


def session_converters(events: DataFrame) -> DataFrame:
    """`converters` plus whether any one session of the user holds a view and a purchase.

    One read: first per (user, session), then per user. Both levels pre-aggregate before their
    shuffle, so neither a long session nor a user with very many sessions piles up in one task.
    A single exchange on the user alone would save a shuffle and lose exactly that.
    """
    per_session = (
        events.where(did_any(VIEW, PURCHASE)).groupBy("user_id", "user_session").agg(*_firsts())
    )
    both = F.col(FIRST_VIEW).isNotNull() & F.col(FIRST_PURCHASE).isNotNull()
    per_user = per_session.groupBy("user_id").agg(
        F.min(FIRST_VIEW).alias(FIRST_VIEW),
        F.min(FIRST_PURCHASE).alias(FIRST_PURCHASE),
        F.max(both).alias("same_session"),
    )
    return valid_converters(per_user)


def same_session_users(events: DataFrame) -> DataFrame:
    """Users with at least one session holding both a view and a purchase, in either order."""
    return (
        events.where(did_any(VIEW, PURCHASE))
        .groupBy("user_id", "user_session")
        .agg(*_firsts())
        .where(F.col(FIRST_VIEW).isNotNull() & F.col(FIRST_PURCHASE).isNotNull())
        .select("user_id")
        .distinct()
    )


def conversion_kind() -> Column:
    """Same session if structurally so, else by the delay; exactly 24 hours is a later return."""
    return F.when(F.col("same_session"), F.lit(SAME_SESSION)).otherwise(
        bucket_label(F.col("delay"), CONVERSION_KIND)
    )


def valid_converters(users: DataFrame) -> DataFrame:
    """Users with both first times in the right order, and the delay between them (FLT-3)."""
    delay = F.col(FIRST_PURCHASE) - F.col(FIRST_VIEW)
    return users.where(delay >= 0).withColumn("delay", delay)
