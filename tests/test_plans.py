"""What the physical plans must and must not contain."""

import re

import pytest

from funnelry.plans import inference, reports, rollup
from funnelry.sources import event_table


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from conftest import DATA

    from funnelry.sources.driver_events import clickstream

    path = str(tmp_path_factory.mktemp("plans") / "events")
    event_table.write_events(clickstream(spark, str(DATA / "sf0.01")), path)
    return event_table.read_events(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


COLUMNS = {
    "funnel_user": {"user_id", "event_type"},
    "funnel_session": {"user_session", "event_type"},
    "funnel_by_category": {"category_code", "user_id", "event_type"},
    "funnel_by_price_quartile": {"price", "user_id", "event_type"},
    "events_per_session": {"user_session"},
    "session_duration": {"user_session", "event_ts"},
    "time_to_convert": {"user_id", "user_session", "event_ts", "event_type"},
    "time_to_convert_distribution": {"user_id", "event_ts", "event_type"},
    "abandonment_by_category": {"category_code", "user_id", "event_type"},
    "top_abandoned_products": {"product_id", "brand", "category_code", "price", "event_type"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_one_scan_of_only_the_needed_columns(stored, name):
    assert read_columns(plan(reports.REPORTS[name](stored))) == [COLUMNS[name]]


def test_gaps_scan_two_columns_for_seconds_and_for_days(stored):
    text = plan(reports.lag_event_gaps(stored))
    assert read_columns(text) == [{"user_id", "event_ts"}] * 2
    # Both are aggregated before anything is shuffled.
    scans = re.findall(r"Exchange hashpartitioning[^\n]*\n[ :]*\+- HashAggregate[^\n]*partial_", text)
    assert len(scans) >= 2


def test_segments_are_counted_once_for_their_tests(stored):
    df = inference.segment_tests(stored, inference.CATEGORY, "view → cart")
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert len(read_columns(final)) == 1 and "ReusedExchange" in final


def test_summary_scans_one_column_per_figure(stored):
    scans = read_columns(plan(reports.dataset_summary(stored)))
    assert scans == [{"event_time"}, {"user_id"}, {"user_session"}]


def test_audit_scans(stored):
    assert read_columns(plan(reports.data_quality(stored))) == [
        {"category_code", "brand", "price"},
        set(),  # rows are counted from the footers
        {"user_id", "user_session", "event_ts", "event_type", "product_id"},
        {"event_type", "user_session"},
        {"event_type", "user_id"},
    ]


@pytest.mark.parametrize("name", reports.REPORTS)
def test_no_sort_before_the_first_shuffle(stored, name):
    """Aggregates over events run by hash; sorting starts on what they leave."""
    for stage in re.split(r"Exchange ", plan(reports.REPORTS[name](stored)))[1:]:
        if "FileScan" in stage and "Union" not in stage:
            own = stage.split("FileScan")[0]  # what follows is another branch
            assert not re.search(r"Sort \[|SortAggregate\(key=\[\w", own)


@pytest.mark.parametrize("name", reports.REPORTS)
def test_rows_are_aggregated_before_they_are_gathered(stored, name):
    """No join, no Python, and nothing but already aggregated rows in a single partition."""
    text = plan(reports.REPORTS[name](stored))
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "SortMergeJoin", "Python", "Pandas"):
        assert unwanted not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[i + 1] and "partial_" in lines[i + 1] or "Union" in lines[i + 2]


@pytest.mark.parametrize("name", [n for n in reports.REPORTS if n != "lag_event_gaps"])
def test_every_shuffle_of_events_is_pre_aggregated(stored, name):
    lines = plan(reports.REPORTS[name](stored)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "Aggregate" in lines[i + 1]


def test_gaps_window_sees_counted_seconds(stored):
    text = plan(reports.lag_event_gaps(stored))
    window, counted = text.index("Window ["), text.index("HashAggregate(keys=[user_id", text.index("Window ["))
    assert counted > window
    # Seconds, seconds of a day, days, days of a user.
    assert text.count("hashpartitioning(user_id") == 4


@pytest.mark.parametrize("name", ["time_to_convert", "time_to_convert_distribution"])
def test_filter_reaches_the_scan(stored, name):
    text = plan(reports.REPORTS[name](stored))
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type", text)


def test_quartiles_need_no_window_and_no_join(stored):
    text = plan(reports.funnel_by_price_quartile(stored))
    assert "Window" not in text and "Join" not in text and "Generate" not in text
    assert "GreaterThan(price" in text


@pytest.mark.parametrize("split", [inference.CATEGORY, inference.PRICE])
@pytest.mark.parametrize("report", [inference.segment_tests, inference.segment_homogeneity])
def test_segment_statistics_shuffle_the_events_once(stored, split, report):
    df = report(stored, split, "view → cart")
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_rollup_is_one_shuffle(stored):
    text = plan(rollup.session_rollup(stored))
    assert text.count("Exchange") == 1 and len(read_columns(text)) == 1
