"""Reports by user over a table stored in buckets by user: no exchange of events (SRC-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry.fixed_values import PURCHASE, VIEW
from funnelry.functions.events import did_any
from funnelry.operators import timing
from funnelry.operators.abandonment import abandoned_counts
from funnelry.operators.funnel import stage_flags, step_counts
from funnelry.plans.reports import delay_histogram
from funnelry.sources.layouts import UserBuckets


def _flags(table: UserBuckets) -> DataFrame:
    return table.per_user(lambda events: stage_flags(events, ["user_id"]))


def funnel_user(table: UserBuckets) -> DataFrame:
    """Q-1."""
    return _flags(table).agg(F.count(F.lit(1)).alias("total_units"), *step_counts())


def abandonment_user(table: UserBuckets) -> DataFrame:
    """Q-10, per user."""
    return _flags(table).agg(*abandoned_counts())


def time_to_convert_distribution(table: UserBuckets) -> DataFrame:
    """Q-9."""
    firsts = table.per_user(lambda e: timing.first_times(e.where(did_any(VIEW, PURCHASE))))
    return delay_histogram(timing.valid_converters(firsts))


BY_USER = {f.__name__: f for f in (funnel_user, abandonment_user, time_to_convert_distribution)}
