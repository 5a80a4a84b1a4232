"""Every report and operator over the given tables, by name.

Each takes the session and the folder of the tables, reads the whole `events` table through the
clickstream adapter and returns a DataFrame. Statistics are rounded here, and only here, so that
two engines can be compared; the library returns them in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelry import fixed_values as fv
from funnelry.functions.events import brand_label, category_label, has_price, top_category
from funnelry.functions.numbers import round_to
from funnelry.functions.sampling import keep_buckets_of, sample_users
from funnelry.functions.times import display_time
from funnelry.operators import bitmaps, cohort, gaps, quality, timing
from funnelry.operators.funnel import stage_flags
from funnelry.operators.ntile import ntile
from funnelry.plans import by_user, inference, reports, rollup
from funnelry.schema import RAW_COLUMNS
from funnelry.sources import event_table, layouts
from funnelry.sources.csv_events import (
    CSV_OPTIONS,
    blank_to_null,
    calibration,
    normalise,
    read_raw_csv,
)
from funnelry.sources.driver_events import clickstream
from funnelry.sources.event_table import clustered, load_report
from funnelry.sources.shared import required_path, shared_root, state_of
from funnelry.streaming.ingest import append_events, load_progress, stream_events

Query = Callable[[SparkSession, str], DataFrame]

TIEBREAK = ("event_id",)
SAMPLE_BUCKETS = 3000
SAMPLE_TARGET = 2000
SAMPLE_FRACTION = 0.25
SMALL_SAMPLE_BUCKETS = 300
LOAD_STEPS = 2
USER_BUCKETS = 8
COHORT_SINCE = 1_705_276_800  # 2024-01-15 00:00:00 UTC
COHORT_VIEWERS = 30
DIGITS = 8


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), DIGITS) for c in columns})


def untidy(events: DataFrame) -> DataFrame:
    """The events as a raw file might hold them: bad, bare and empty times, lost sessions."""
    kind = F.col("event_id") % 50
    time = (
        F.when(kind == 0, F.lit("bad"))
        .when(kind == 1, F.replace(F.col("event_time"), F.lit(fv.UTC_SUFFIX), F.lit("")))
        .when(kind == 2, F.lit(""))
        .otherwise(F.col("event_time"))
    )
    session = F.when(kind != 3, F.col("user_session"))
    return events.drop("event_ts").withColumns({"event_time": time, "user_session": session})


def sampled(events: DataFrame) -> DataFrame:
    return sample_users(events, SAMPLE_BUCKETS).select(
        "event_id", "event_ts", "event_type", "user_id", "user_session"
    )


def sampled_by_fraction(events: DataFrame) -> DataFrame:
    return sample_users(events, keep_buckets_of(SAMPLE_FRACTION)).select("event_id", "user_id")


def laid_out(events: DataFrame) -> DataFrame:
    return clustered(events).select("event_id", "user_id", "event_ts", "event_type", "price")


def blanked(events: DataFrame) -> DataFrame:
    """The raw columns with the words for a missing value that a file might hold."""
    kind = F.col("event_id") % 12
    brand = F.when(kind == 3, "n/a").when(kind == 4, "None").otherwise(F.col("brand"))
    price = F.when(kind == 5, F.lit(float("nan"))).otherwise(F.col("price"))
    raw = events.withColumns({"brand": brand, "price": price})
    return blank_to_null(raw.select("event_id", *RAW_COLUMNS))


def calibrated(events: DataFrame) -> DataFrame:
    return calibration(events.agg(F.count(F.lit(1)).alias("rows")), SAMPLE_TARGET)


def normalised(events: DataFrame) -> DataFrame:
    return normalise(untidy(events)).withColumn("shown_time", display_time(F.col("event_ts")))


def loaded(events: DataFrame) -> DataFrame:
    return load_report(normalise(sample_users(untidy(events), SAMPLE_BUCKETS)))


def loaded_in_steps(events: DataFrame) -> DataFrame:
    """Raw files that arrive one after the other, and the running counts of their load."""
    spark, root = events.sparkSession, required_path(events.sparkSession, "steps")
    raw, table = f"{root}/raw", f"{root}/table"
    step = F.pmod(F.col("event_id"), F.lit(LOAD_STEPS))
    for k in range(LOAD_STEPS):
        part = untidy(events).where(step == k).select(*RAW_COLUMNS)
        part.write.options(**CSV_OPTIONS).mode("append").csv(raw)
        stream = stream_events(spark, raw, SAMPLE_BUCKETS)
        append_events(stream, raw, table, f"{root}/checkpoint").awaitTermination()
    return load_progress(spark, table).drop("stream")


def reloaded(events: DataFrame) -> DataFrame:
    """A table that is loaded with some of the events, and then with all of them."""
    path = required_path(events.sparkSession, "reloaded")
    event_table.write_events(events.where(F.col("event_id") % 2 == 0), path)
    event_table.write_events(events, path)
    return event_table.read_events(events.sparkSession, path)


def from_multi_line_files(events: DataFrame) -> DataFrame:
    """The raw columns out of CSV files where some brands go over two lines."""
    path = required_path(events.sparkSession, "lines")
    broken = F.concat(F.col("brand"), F.lit('\n"and", more'))
    brand = F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, broken).otherwise(F.col("brand"))
    raw = events.withColumn("brand", brand).select(*RAW_COLUMNS)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.write.options(**CSV_OPTIONS, **kept).csv(path)
    return read_raw_csv(events.sparkSession, path, multi_line=True)


def in_user_buckets(events: DataFrame) -> layouts.UserBuckets:
    spark, table = events.sparkSession, f"buckets_{uuid.uuid4().hex}"
    layouts.save_user_buckets(events, table, USER_BUCKETS, required_path(spark, "buckets"))
    return layouts.read_user_buckets(spark, table)


def sampled_from_files(events: DataFrame) -> DataFrame:
    path = required_path(events.sparkSession, "samples")
    layouts.write_for_samples(events, path)
    return layouts.read_sample(events.sparkSession, path, SMALL_SAMPLE_BUCKETS)


def buyers(events: DataFrame) -> DataFrame:
    return cohort.buyers_since(events, fv.PURCHASE, COHORT_SINCE)


def cohort_funnel(events: DataFrame) -> DataFrame:
    chosen = cohort.restricted(events, buyers(events))
    return reports.funnel_by_category(chosen, min_viewers=COHORT_VIEWERS)


def cohort_events(events: DataFrame) -> DataFrame:
    marked = cohort.with_membership(events, buyers(events))
    return marked.groupBy("in_cohort", "event_type").agg(F.count(F.lit(1)).alias("events"))


def daily_users(events: DataFrame) -> DataFrame:
    """Users of each day, and of all days (no day) from the bitmaps of the days."""
    days = bitmaps.user_bitmaps(events, bitmaps.day())
    whole = bitmaps.distinct_users(days).select(F.lit(None).cast("long").alias("day"), "users")
    return bitmaps.distinct_users(days, "day").unionByName(whole)


def indicators(events: DataFrame) -> DataFrame:
    viewed, carted, purchased = (F.col(c) for c in ("viewed", "carted", "purchased"))
    flags = {
        "viewed": viewed,
        "carted": carted,
        "purchased": purchased,
        "reached_cart": viewed & carted,
        "reached_purchase": viewed & carted & purchased,
        "abandoned": carted & ~purchased,
    }
    return stage_flags(events, ["user_id", "user_session"]).select(
        "user_id", "user_session", *(c.cast("int").alias(name) for name, c in flags.items())
    )


def categories(events: DataFrame) -> DataFrame:
    return events.groupBy(
        top_category().alias("top_category"),
        category_label().alias("category_code"),
        brand_label().alias("brand"),
    ).agg(F.count(F.lit(1)).alias("events"))


def price_tiles(events: DataFrame) -> DataFrame:
    priced = events.where(has_price())
    return ntile(priced, ["price", *TIEBREAK], fv.QUARTILES, "price_quartile")


def untracked(events: DataFrame) -> DataFrame:
    grains = ((fv.PER_USER, "user_id"), (fv.PER_SESSION, "user_session"))
    users, sessions = (
        quality.units_without_view(events, unit).select(F.lit(name).alias("grain"), "units")
        for name, unit in grains
    )
    return users.unionByName(sessions)


def price_labels(events: DataFrame) -> DataFrame:
    return inference.price_segments(events, TIEBREAK).select(
        F.col("position").alias("price_quartile"), "segment"
    )


def _intervals(df: DataFrame) -> DataFrame:
    return rounded(df, "rate", "ci_low", "ci_high")


def _steps(df: DataFrame) -> DataFrame:
    return rounded(_intervals(df), "pct_previous", "end_to_end")


def _tests(events: DataFrame, split: str, step: str) -> DataFrame:
    tests = inference.segment_tests(events, split, step, TIEBREAK)
    return rounded(_intervals(tests), "rate_vs_rest", "z", "p_value", "bonferroni_alpha")


def _chi2(events: DataFrame, split: str, step: str) -> DataFrame:
    found = inference.segment_homogeneity(events, split, step, TIEBREAK)
    return rounded(found, "chi2", "p_value")


def _series(events: DataFrame, split: str) -> DataFrame:
    series = inference.segment_rate_series(events, split, TIEBREAK)
    return rounded(series, "rate_pct", "err_minus", "err_plus")


STEP_KEYS = {"cart": fv.VIEW_TO_CART, "purchase": fv.CART_TO_PURCHASE}
SPLITS = (inference.CATEGORY, inference.PRICE)


def over_events() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The queries as functions of an event table with an `event_id`."""
    found: dict[str, Callable[[DataFrame], DataFrame]] = dict(reports.REPORTS)
    found["funnel_by_price_quartile"] = lambda e: reports.funnel_by_price_quartile(e, TIEBREAK)
    found |= {
        "top_segments": lambda e: reports.funnel_by_category(e, min_viewers=380, limit=5),
        "top_products": lambda e: reports.top_abandoned_products(e, min_cart_adds=20, limit=5),
        "sample_users": sampled,
        "sample_fraction": sampled_by_fraction,
        "clustered_layout": laid_out,
        "blank_to_null": blanked,
        "calibrate_keep_buckets": calibrated,
        "normalise_events": normalised,
        "load_report": loaded,
        "multi_line_csv": from_multi_line_files,
        "running_load": loaded_in_steps,
        "reloaded_table": reloaded,
        "sample_from_files": sampled_from_files,
        "cohort_funnel": cohort_funnel,
        "cohort_events": cohort_events,
        "daily_users": daily_users,
        "event_indicators": indicators,
        "top_category": categories,
        "segment_label": price_labels,
        "price_ntile": price_tiles,
        # The same operator under its earlier name.
        "price_ntile_scalable": price_tiles,
        "event_gaps": gaps.event_gaps,
        "first_times": timing.first_times,
        "same_session_converters": timing.same_session_users,
        "duplicate_groups": quality.duplicate_groups,
        "missing_value_audit": quality.missing_values,
        "tracking_gaps": untracked,
        "distinct_counts": quality.distinct_counts,
        "funnel_steps_user": lambda e: _steps(inference.funnel_steps_user(e)),
        "funnel_steps_session": lambda e: _steps(inference.funnel_steps_session(e)),
        "abandonment_rates": lambda e: _intervals(inference.abandonment_rates(e)),
        "significant_segments": lambda e: inference.significant_segments(e, TIEBREAK),
    }
    for name, report in by_user.BY_USER.items():
        found[f"bucketed_{name}"] = lambda e, report=report: report(in_user_buckets(e))
    for split in SPLITS:
        found[f"segment_rate_series_{split}"] = lambda e, split=split: _series(e, split)
        for key, step in STEP_KEYS.items():
            found[f"chi2_{split}_{key}"] = lambda e, a=split, b=step: _chi2(e, a, b)
            found[f"segment_tests_{split}_{key}"] = lambda e, a=split, b=step: _tests(e, a, b)
    return found


def _reading(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(clickstream(spark, sf_dir))


def over_rollup() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The queries that need only the summary per user and session."""
    return {f"rollup_{name}": report for name, report in rollup.ROLLUP_REPORTS.items()}


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a folder's events: stored by the first query that asks for it, then read.

    It lies in the session's shared folder, named by the files of the events as they are now, with
    their sizes and times, so that events written anew have a summary of their own.
    """
    root = shared_root(spark)
    if root is None:
        return rollup.session_rollup(clickstream(spark, sf_dir))
    path = f"{root}/summary-{state_of(spark, f'{sf_dir}/events.parquet')}"
    if path not in _stored:
        rollup.store_rollup(clickstream(spark, sf_dir), path)
        _stored.add(path)
    return rollup.read_rollup(spark, path)


_stored: set[str] = set()


def all_queries() -> dict[str, Query]:
    found = {name: _reading(query) for name, query in over_events().items()}
    for name, report in over_rollup().items():
        found[name] = lambda spark, sf_dir, report=report: report(summary(spark, sf_dir))
    return found
