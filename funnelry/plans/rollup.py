"""Several reports from one pass: a stored summary per user and session.

Asked one by one, the user and session reports each scan and shuffle the events. Together they
need only this summary, which is several times smaller than the events and is built with one
scan and one shuffle. Store it, then read the reports from it.

A session id is not assumed to belong to one user: session reports group the summary by the
session alone, so results equal those over the events in every case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelry import fixed_values as fv
from funnelry.functions.events import only_if
from funnelry.operators.abandonment import abandoned_counts
from funnelry.operators.funnel import STAGES, stage_flags, step_counts
from funnelry.operators.timing import FIRST_PURCHASE, FIRST_VIEW, valid_converters
from funnelry.plans import reports


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per user and session: size, span, stage flags, first times."""
    return stage_flags(
        events,
        ["user_id", "user_session"],
        F.count(F.lit(1)).alias("n_events"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
        F.min(only_if(fv.VIEW, "event_ts")).alias(FIRST_VIEW),
        F.min(only_if(fv.PURCHASE, "event_ts")).alias(FIRST_PURCHASE),
    )


def store_rollup(events: DataFrame, path: str) -> DataFrame:
    """Writes the summary and returns it as read back, free of the work behind it."""
    session_rollup(events).write.mode("overwrite").parquet(path)
    return read_rollup(events.sparkSession, path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _flags(rollup: DataFrame, unit: str) -> DataFrame:
    return rollup.groupBy(unit).agg(*(F.max(flag).alias(flag) for flag in STAGES))


def _funnel(rollup: DataFrame, unit: str) -> DataFrame:
    return _flags(rollup, unit).agg(F.count(F.lit(1)).alias("total_units"), *step_counts())


def funnel_user(rollup: DataFrame) -> DataFrame:
    return _funnel(rollup, "user_id")


def funnel_session(rollup: DataFrame) -> DataFrame:
    return _funnel(rollup, "user_session")


def events_per_session(rollup: DataFrame) -> DataFrame:
    return reports.session_size_histogram(
        rollup.groupBy("user_session").agg(F.sum("n_events").alias("n_events"))
    )


def session_duration(rollup: DataFrame) -> DataFrame:
    span = F.max("last_ts") - F.min("first_ts")
    return reports.session_span_histogram(
        rollup.groupBy("user_session").agg(span.alias("duration_sec"))
    )


def _converters(rollup: DataFrame) -> DataFrame:
    both = F.col(FIRST_VIEW).isNotNull() & F.col(FIRST_PURCHASE).isNotNull()
    return valid_converters(
        rollup.groupBy("user_id").agg(
            F.min(FIRST_VIEW).alias(FIRST_VIEW),
            F.min(FIRST_PURCHASE).alias(FIRST_PURCHASE),
            F.max(both).alias("same_session"),
        )
    )


def time_to_convert(rollup: DataFrame) -> DataFrame:
    return reports.conversion_kinds(_converters(rollup))


def time_to_convert_distribution(rollup: DataFrame) -> DataFrame:
    return reports.delay_histogram(_converters(rollup))


def abandonment_overall(rollup: DataFrame) -> DataFrame:
    grains = ((fv.PER_USER, "user_id"), (fv.PER_SESSION, "user_session"))
    return reduce(
        DataFrame.unionByName,
        (
            _flags(rollup, unit)
            .agg(*abandoned_counts())
            .select(F.lit(name).alias("grain"), "carters", "abandoned")
            for name, unit in grains
        ),
    )


ROLLUP_REPORTS = {
    f.__name__: f
    for f in (
        funnel_user,
        funnel_session,
        events_per_session,
        session_duration,
        time_to_convert,
        time_to_convert_distribution,
        abandonment_overall,
    )
}
