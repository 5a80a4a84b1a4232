"""Stored layouts, cohorts and bitmaps: rows, plans and what is read (SRC-3, SRC-11, JOIN-1, AGG-20)."""

import re

import pytest
from pyspark.sql import functions as F

from funnelry.functions.sampling import sample_users
from funnelry.operators import bitmaps, cohort, quality
from funnelry.plans import by_user, reports
from funnelry.sources import layouts
from funnelry.verification import queries


def many(events, hot=1500):
    kinds = ("view", "cart", "purchase", "view")
    rows = [(i % 200, f"s{i % 300}", i * 60, kinds[i * 7 % 4]) for i in range(2000)]
    rows += [(7, f"h{i % 5}", i, kinds[i % 4]) for i in range(hot)]
    return events(*rows, (None, "n", 1, "view"), (None, "n", 2, "purchase"))


@pytest.fixture
def table(spark, events, tmp_path):
    df = many(events).repartition(6)
    layouts.save_user_buckets(df, "by_user_test", 8, str(tmp_path / "buckets"))
    return df, layouts.read_user_buckets(spark, "by_user_test")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_hold_the_rows_and_no_hot_user(table, rows):
    df, stored = table
    whole = stored.even.unionByName(stored.hot)
    assert sorted(map(str, rows(whole))) == sorted(map(str, rows(df.select(*whole.columns))))
    assert {r.user_id for r in stored.hot.select("user_id").distinct().collect()} == {7}
    assert stored.even.where("user_id = 7").count() == 0


def test_a_hot_user_is_spread_over_tasks(spark, events, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layouts.save_user_buckets(many(events, 4000), "hot_test", 8, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in layouts.read_user_buckets(spark, "hot_test").hot.inputFiles()]
    assert len(files) > 1


@pytest.mark.parametrize("name", by_user.BY_USER)
def test_reports_by_user_need_no_exchange_of_events(table, rows, name):
    df, stored = table
    found = by_user.BY_USER[name](stored)
    plain = {
        "funnel_user": reports.funnel_user,
        "abandonment_user": lambda e: reports.abandonment_overall(e).where("grain = 'per user'").drop("grain"),
        "time_to_convert_distribution": reports.time_to_convert_distribution,
    }[name]
    text = plan(found)
    assert len(re.findall(r"FileScan parquet [\w.]*by_user_test\[", text)) == 1
    assert "Bucketed: true" in text
    assert text.count("Exchange hashpartitioning(user_id") == 1  # that of the hot users
    even = text[: text.index("by_user_test[")]
    assert "Exchange hashpartitioning" not in even.replace("Exchange hashpartitioning(_groupingexpression", "")
    assert rows(found) == rows(plain(df))


def scanned(df):
    """Rows that the scan of a table has given out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    node = node.executedPlan() if "Adaptive" in node.nodeName() else node
    leaves = node.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_sample_reads_its_share_of_the_files(spark, events, rows, tmp_path):
    path = str(tmp_path / "samples")
    df = events(*((i % 4000, f"s{i % 9}", i, "view") for i in range(20_000)), (None, "n", 1, "view"))
    layouts.write_for_samples(df, path, 200)
    for buckets in (1, 100, 2500, 10_000):
        sample = layouts.read_sample(spark, path, buckets)
        assert sorted(rows(sample)) == sorted(rows(sample_users(df, buckets)))
        share = scanned(sample) / 20_000
        assert buckets / 10_000 * 0.7 <= share <= buckets / 10_000 + 0.02


def test_samples_by_files_of_one_user(spark, events, tmp_path):
    path = str(tmp_path / "samples")
    layouts.write_for_samples(events(*((5, "s", 1, "view") for _ in range(400))).coalesce(1), path, 8)
    assert layouts.read_sample(spark, path, 10_000).count() == 400
    assert len(layouts.read_sample(spark, path, 10_000).inputFiles()) > 1


def test_cohorts_with_missing_users(spark, events, rows):
    df = many(events, 10)
    chosen = spark.createDataFrame([(3,), (3,), (None,), (7,), (10**9,)], "user_id long")
    found = cohort.restricted(df, chosen)
    assert sorted(rows(found)) == sorted(rows(df.where("user_id IN (3, 7)")))
    marked = cohort.with_membership(df, chosen)
    assert marked.columns == [*df.columns, "in_cohort"]
    assert marked.count() == df.count() and marked.where("in_cohort IS NULL").count() == 0
    assert sorted(rows(marked.where("in_cohort").drop("in_cohort"))) == sorted(rows(found))
    assert "ExistenceJoin" in plan(marked)
    assert cohort.restricted(df, chosen.limit(0)).count() == 0


def test_a_bloom_filter_of_the_cohort_reaches_the_scan(spark, events, tmp_path):
    many(events).write.parquet(str(tmp_path / "events"))
    spark.range(5000).selectExpr("id AS user_id", "id % 50 AS grade").write.parquet(str(tmp_path / "users"))
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df = spark.read.parquet(str(tmp_path / "events"))
        chosen = spark.read.parquet(str(tmp_path / "users")).where("grade = 7").select("user_id")
        found = cohort.restricted(df, chosen)
        text = plan(found)
        assert "might_contain" in text or "bloom_filter_agg" in text
        assert "LeftSemi" in text
        assert found.count() == df.where("user_id % 50 = 7").count()
    finally:
        for name in wanted:
            spark.conf.unset(name)


def test_bitmaps_count_as_distinct_does(events, rows):
    df = events(*((u, "s", d * 86_400 + 5, "view") for d in range(4) for u in (0, -1, 5, d, 10**12 + d, -(10**12), 32_768, 32_769, None, 5)))
    days = bitmaps.user_bitmaps(df, bitmaps.day())
    plain = df.groupBy(bitmaps.day()).agg(F.count_distinct("user_id").alias("users"))
    assert sorted(rows(bitmaps.distinct_users(days, "day"))) == sorted(rows(plain))
    assert bitmaps.distinct_users(days).first()[0] == quality.distinct_counts(df).first().users
    text = plan(bitmaps.distinct_users(bitmaps.user_bitmaps(df)))
    assert "partial_bitmap_construct_agg" in text and "hashpartitioning(user_id" not in text
    assert rows(bitmaps.distinct_users(bitmaps.user_bitmaps(events()))) == [(0,)]


def test_a_summary_follows_its_table(spark, events, tmp_path):
    folder = str(tmp_path / "data")
    source = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for n in (20, 50):
        df = spark.range(n).selectExpr(
            "id AS event_id", "TIMESTAMP_NTZ '2024-01-05 00:00:00' AS ts", "id AS user_id",
            "'view' AS event_type", "1.0D AS value", """'{"k": 3}' AS props""",
        )
        df.to(spark.createDataFrame([], source).schema).write.mode("overwrite").parquet(f"{folder}/events.parquet")
        for _ in range(2):
            found = queries.all_queries()["rollup_funnel_user"](spark, folder).first()
            assert found.total_units == n
