"""Stage flags, categories, thresholds (PRJ-1..6, AGG-1..3, AGG-11..16, FLT-6)."""

import pytest

from funnelry.operators.abandonment import abandonment_by
from funnelry.operators.funnel import stage_flags
from funnelry.plans import reports


def test_purchase_alone_reaches_no_step(events, rows):
    df = events((1, "s1", 1, "purchase"), (2, "s2", 1, "view"))
    assert rows(reports.funnel_user(df)) == [(2, 1, 0, 0)]


def test_order_in_time_does_not_matter(events, rows):
    df = events((1, "s", 1, "purchase"), (1, "s", 2, "cart"), (1, "s", 3, "view"))
    assert rows(reports.funnel_user(df)) == [(1, 1, 1, 1)]


def test_session_must_hold_the_whole_journey(events, rows):
    df = events((1, "s1", 1, "view"), (1, "s2", 2, "cart"), (1, "s2", 3, "purchase"))
    assert rows(reports.funnel_user(df)) == [(1, 1, 1, 1)]
    assert rows(reports.funnel_session(df)) == [(2, 1, 0, 0)]


def test_unknown_and_missing_types_count_as_units_only(events, rows):
    df = events((1, "s1", 1, "wishlist"), (2, "s2", 1, None), (2, "s2", 5, "view"))
    assert rows(reports.funnel_user(df)) == [(2, 1, 0, 0)]
    assert rows(stage_flags(events((1, "s", 1, None)), ["user_id"])) == [(1, None, None, None)]


def test_top_category(events, rows):
    codes = [None, "", "a", "a.b.c", ".a"]
    df = events(*((i, "s", 1, "view", {"category_code": c}) for i, c in enumerate(codes)))
    found = dict((r[0], r[1]) for r in rows(reports.funnel_by_category(df, min_viewers=1)))
    assert found == {"(unknown)": 2, "a": 2, "": 1}


@pytest.mark.parametrize("viewers, kept", [(199, 0), (200, 1)])
def test_category_needs_enough_viewers(events, viewers, kept):
    df = events(*((i, "s", 1, "view") for i in range(viewers)))
    assert reports.funnel_by_category(df).count() == kept


@pytest.mark.parametrize("carters, kept", [(49, 0), (50, 1)])
def test_category_needs_enough_carters(events, carters, kept):
    df = events(*((i, "s", 1, "cart") for i in range(carters)))
    assert reports.abandonment_by_category(df).count() == kept


@pytest.mark.parametrize("adds, kept", [(19, 0), (20, 1)])
def test_product_needs_enough_cart_adds(events, adds, kept):
    df = events(*((i, "s", 1, "cart") for i in range(adds)))
    assert reports.top_abandoned_products(df).count() == kept


def test_limit_cuts_ties_by_name(events, rows):
    df = events(*((i, "s", 1, "view", {"category_code": c}) for i in range(3) for c in "dbca"))
    assert [r[0] for r in rows(reports.funnel_by_category(df, 1, 2))] == ["a", "b"]


def test_abandonment_needs_no_view_and_stays_in_its_category(events, rows):
    df = events(
        (1, "s1", 1, "cart", {"category_code": "a"}),
        (1, "s1", 2, "purchase", {"category_code": "b"}),
        (2, "s2", 1, "cart", {"category_code": "a"}),
        (2, "s3", 2, "purchase", {"category_code": "a"}),
    )
    assert rows(reports.abandonment_overall(df)) == [("per user", 2, 0), ("per session", 2, 1)]
    per_category = reports.abandonment_by_category(df, min_carters=1)
    assert rows(per_category) == [("a", 2, 1, 50.0)]


def test_segments_without_carts_are_zero_not_missing(events, rows):
    df = events((1, "s", 1, "view", {"category_code": "a"}))
    assert rows(abandonment_by(df, "category_code")) == [("a", 0, 0)]
    assert rows(reports.abandonment_overall(df)) == [("per user", 0, 0), ("per session", 0, 0)]


def test_products_count_events_and_keep_empty_brands(events, rows):
    sold = {"brand": "", "category_code": None, "price": -1.0}
    df = events(
        (1, "s", 1, "cart", sold),
        (1, "s", 2, "purchase", sold),
        (1, "s", 3, "purchase", sold | {"price": 2.01}),
        (1, "s", 4, "view", sold | {"price": None}),
    )
    report = reports.top_abandoned_products(df, min_cart_adds=1)
    assert rows(report) == [(1, "", "(unknown)", 0.0, 1, 2, 2.0)]


def test_product_ratio_without_carts(events, rows):
    report = reports.top_abandoned_products(events((1, "s", 1, "purchase")), min_cart_adds=0)
    assert rows(report)[0][-1] is None


def test_empty_table(events, rows):
    df = events()
    assert rows(reports.funnel_user(df)) == [(0, None, None, None)]
    assert rows(reports.abandonment_overall(df)) == [
        ("per user", None, None), ("per session", None, None),
    ]
    assert rows(reports.dataset_summary(df)) == [(0, 0, 0, None, None)]
    for name in (
        "funnel_by_category", "funnel_by_price_quartile", "events_per_session",
        "session_duration", "lag_event_gaps", "time_to_convert",
        "time_to_convert_distribution", "abandonment_by_category", "top_abandoned_products",
    ):
        assert rows(reports.REPORTS[name](df)) == []
    values = [(v, p) for _, v, p in rows(reports.data_quality(df))]
    assert values == [(0, None), (None, None), (None, None), (None, None), (0, None), (0, None), (0, None)]
