"""Checks before trusting a funnel (AGG-17..21, FLT-5, FLT-7, SET-2).

Repeated actions are found by elimination. Nearly all rows of a sound table occur once, and to see
that, 64 bits of a row are enough: the first pass counts fingerprints of the five identity columns,
the second reads again only rows whose fingerprint occurs more than once and compares the columns
themselves. So the wide columns are shuffled for the rows that may repeat, not for all, and rows that
share a fingerprint by accident are told apart. The marks of the second pass are sent to every
executor up to MARKS; a table with more repeated actions than that is grouped by its columns at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry import fixed_values as fv
from funnelry.functions.events import did_any, is_blank, lacks_price, ones
from funnelry.functions.numbers import percent
from funnelry.operators.funnel import stage_flags
from funnelry.schema import IDENTITY_COLUMNS


def missing_values(events: DataFrame) -> DataFrame:
    """One wide row: events, and how many lack a category, a brand or a usable price."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        ones(is_blank("category_code")).alias("missing_category"),
        ones(is_blank("brand")).alias("missing_brand"),
        ones(lacks_price()).alias("missing_price"),
    ).select(
        "*",
        *(
            percent(F.col(f"missing_{c}"), F.col("events"), 2).alias(f"missing_{c}_pct")
            for c in ("category", "brand", "price")
        ),
    )


# Repeated fingerprints that are sent to every executor, eight bytes each.
MARKS = 500_000


def fingerprint() -> Column:
    """64 bits of what identifies an action; NULLs are told from values by their places."""
    missing = F.array(*(F.col(c).isNull() for c in IDENTITY_COLUMNS))
    return F.xxhash64(*IDENTITY_COLUMNS, missing)


def repeated_marks(events: DataFrame) -> DataFrame | None:
    """Fingerprints (mark) of more than one row; None if there are more than MARKS."""
    counts = events.groupBy(fingerprint().alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where("n > 1").select("mark").limit(MARKS + 1).collect()
    if len(found) > MARKS:
        return None
    return events.sparkSession.createDataFrame(found, "mark bigint")


def suspects(events: DataFrame) -> DataFrame:
    """The rows, by their identity columns, that may be recorded more than once."""
    rows = events.select(*IDENTITY_COLUMNS)
    marks = repeated_marks(events)
    if marks is None:
        return rows
    marked = rows.withColumn("_mark", fingerprint())
    return marked.join(F.broadcast(marks), F.col("_mark") == F.col("mark"), "left_semi").drop("_mark")


def copies(events: DataFrame) -> DataFrame:
    """Each recorded action with its number of rows; NULL keys group together."""
    return events.groupBy(*IDENTITY_COLUMNS).agg(F.count(F.lit(1)).alias("cnt"))


def duplicate_groups(events: DataFrame) -> DataFrame:
    """Actions recorded more than once."""
    return copies(suspects(events)).where(F.col("cnt") > 1)


def redundant_rows(events: DataFrame) -> DataFrame:
    """One row: all events, and rows that only repeat another one."""
    repeats = copies(suspects(events)).agg(F.sum(F.col("cnt") - 1).alias("redundant"))
    total = events.agg(F.count(F.lit(1)).alias("events"))
    return total.unionByName(repeats, allowMissingColumns=True).agg(
        F.max("events").alias("events"), F.coalesce(F.max("redundant"), F.lit(0)).alias("redundant")
    )


def units_without_view(events: DataFrame, unit: str) -> DataFrame:
    """One row: units that bought something and never viewed anything."""
    flags = stage_flags(events.where(did_any(fv.VIEW, fv.PURCHASE)), [unit])
    return flags.where(F.col("purchased") & ~F.col("viewed")).agg(
        F.count(F.lit(1)).alias("units")
    )


def metric(df: DataFrame, name: str, value: Column, pct: Column | None = None) -> DataFrame:
    """One audit metric as (metric, value, pct)."""
    share = F.lit(None) if pct is None else pct
    return df.select(
        F.lit(name).alias("metric"),
        value.cast("bigint").alias("value"),
        share.cast("double").alias("pct"),
    )


def metrics(df: DataFrame, rows: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Several (name, value column, pct column) metrics out of one wide row, in order."""
    return df.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(name).alias("metric"),
                        F.col(value).cast("bigint").alias("value"),
                        (F.lit(None) if pct is None else F.col(pct)).cast("double").alias("pct"),
                    )
                    for name, value, pct in rows
                )
            )
        )
    )


def distinct_counts(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: events, users, sessions, first and last event time as text.

    Exact by default: each distinct count is an aggregate of its own over one column. In a single
    aggregate Spark would copy every row per count and, for the text extremes, sort them all.
    `approximate` trades about 5% error for sketches that never shuffle the ids.
    """
    extent = [
        F.count(F.lit(1)).alias("events"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
    ]
    names = {"users": "user_id", "sessions": "user_session"}
    order = ["events", "users", "sessions", "first_event", "last_event"]
    if approximate:
        counts = [F.approx_count_distinct(c).alias(name) for name, c in names.items()]
        return events.agg(*extent, *counts).select(*order)
    parts = [events.agg(*extent)]
    parts += [events.agg(F.count_distinct(c).alias(name)) for name, c in names.items()]
    # Three rows with a value each; the others of a column are NULL.
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.agg(*(F.max(c).alias(c) for c in order))
