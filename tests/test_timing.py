"""First times, delays, gaps and histograms (AGG-5..10, WIN-2, PRJ-7)."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from funnelry import fixed_values as fv
from funnelry.functions.numbers import bucket_label
from funnelry.operators.gaps import event_gaps
from funnelry.plans import reports


def labels(spark, table, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    return [r[0] for r in df.select(bucket_label(F.col("v"), table)).collect()]


@pytest.mark.parametrize(
    "table, edges",
    [
        (fv.EVENTS_PER_SESSION, {1: "1", 2: "2", 3: "3-5", 5: "3-5", 6: "6-10", 10: "6-10",
                                 11: "11-20", 20: "11-20", 21: "21+"}),
        (fv.SESSION_DURATION, {0: "0s (single event)", 1: "< 1 min", 59: "< 1 min",
                               60: "1-5 min", 300: "5-30 min", 1800: "30 min - 2 h",
                               7199: "30 min - 2 h", 7200: "> 2 h (suspicious)"}),
        (fv.EVENT_GAP, {0: "0s (same second)", 1: "< 1 min", 60: "1-10 min", 600: "10-30 min",
                        1800: "30 min - 24 h", 86399: "30 min - 24 h",
                        86400: "> 24 h (returned another day)"}),
        (fv.CONVERSION_DELAY, {0: "< 10 min", 599: "< 10 min", 600: "10-60 min",
                               3600: "1-24 h", 86399: "1-24 h", 86400: "1-7 days",
                               604800: "> 7 days"}),
    ],
)
def test_bucket_edges(spark, table, edges):
    assert labels(spark, table, edges) == list(edges.values())


@pytest.mark.parametrize(
    "delay, kind",
    [(0, "same day (different session)"), (86399, "same day (different session)"),
     (86400, "later return (> 1 day)")],
)
def test_conversion_kind(events, rows, delay, kind):
    df = events((1, "s1", 100, "view"), (1, "s2", 100 + delay, "purchase"))
    hours = round(delay / 3600, 2)
    assert rows(reports.time_to_convert(df)) == [(kind, 1, hours)]


def test_same_session_in_either_order(events, rows):
    df = events(
        (1, "s0", 100, "view"), (1, "s1", 200, "purchase"), (1, "s1", 300, "view"),
    )
    assert rows(reports.time_to_convert(df)) == [("same session", 1, 0.03)]


def test_one_session_id_of_two_users_is_two_sessions(events, rows):
    df = events((1, "s", 1, "view"), (2, "s", 2, "purchase"), (2, "t", 1, "view"))
    assert rows(reports.time_to_convert(df)) == [("same day (different session)", 1, 0.0)]


def test_purchase_before_view_is_no_conversion(events, rows):
    df = events((1, "s", 100, "purchase"), (1, "s", 200, "view"))
    assert rows(reports.time_to_convert(df)) == []
    assert rows(reports.time_to_convert_distribution(df)) == []


def test_events_in_one_second(events, rows):
    df = events((1, "s", 5, "view"), (1, "s", 5, "cart"))
    assert rows(reports.session_duration(df)) == [("0s (single event)", 0, 1)]
    assert rows(reports.lag_event_gaps(df)) == [("0s (same second)", 0, 1)]


def plain_gaps(df):
    before = F.lag("event_ts").over(
        Window.partitionBy("user_id").orderBy("event_ts", "event_type")
    )
    gap = df.select("user_id", "event_ts", (F.col("event_ts") - before).alias("gap"))
    return Counter(tuple(r) for r in gap.where("gap IS NOT NULL").collect())


def counted(df):
    return {(r.user_id, r.event_ts, r.gap_sec): r.gaps for r in event_gaps(df).collect()}


def test_gaps_equal_a_plain_lag(events):
    draw = random.Random(7)
    # User 1 owns most rows, many of them in the same second.
    users = [1] * 400 + [draw.randrange(2, 30) for _ in range(300)]
    df = events(*((u, "s", draw.choice([9, draw.randrange(500)]), "view") for u in users))
    assert counted(df) == plain_gaps(df)


def test_gaps_over_days_equal_a_plain_lag(events):
    draw = random.Random(8)
    day = 86_400
    seconds = [draw.choice([0, day - 1, day, 5 * day, draw.randrange(9 * day)]) - 3 * day for _ in range(300)]
    df = events(*((draw.choice([1, 1, 2, None]), "s", t, "view") for t in seconds))
    assert counted(df) == plain_gaps(df)


def test_a_busy_user_is_spread_over_partitions(spark, events):
    df = events(*((1, "s", 7_000 * k, "view") for k in range(600)))
    gaps = event_gaps(df).where("gap_sec = 7000 AND event_ts % 86400 >= 7000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        sizes = [r["count"] for r in gaps.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 10 and max(sizes) < 0.3 * sum(sizes)


def test_events_without_a_time_have_no_gap(events):
    df = events((1, "s", 5, "view"), (1, "s", 5, "view"))
    timeless = df.unionByName(df.withColumn("event_ts", F.lit(None).cast("bigint")))
    assert counted(timeless) == {(1, 5, 0): 1}


def test_gaps_of_one_event(events):
    assert counted(events((1, "s", 5, "view"))) == {}
