"""The audit (AGG-17..21)."""

import random

import pytest
from pyspark.sql import functions as F

from funnelry.operators import quality
from funnelry.plans import reports


def test_copies_beyond_the_first_are_redundant(events, rows):
    one = (1, "s", 5, "view", {"price": 1.0})
    df = events(one, one, (1, "s", 5, "view", {"price": 2.0}), (1, "s", 6, "view"))
    assert rows(quality.redundant_rows(df)) == [(4, 2)]
    assert [r.cnt for r in quality.duplicate_groups(df).collect()] == [3]


def test_missing_keys_are_equal(events, rows):
    one = (1, "s", 5, None, {"product_id": None})
    assert rows(quality.redundant_rows(events(one, one))) == [(2, 1)]


def test_missing_values(events, rows):
    df = events(
        (1, "s", 1, "view", {"brand": "", "price": 0.0}),
        (1, "s", 2, "view", {"brand": None, "price": -1.0}),
        (1, "s", 3, "view", {"category_code": "", "price": None}),
        (1, "s", 4, "view", {"price": float("nan")}),
    )
    assert rows(quality.missing_values(df)) == [(4, 1, 2, 4, 25.0, 50.0, 100.0)]


def test_purchases_without_view(events, rows):
    df = events(
        (1, "s1", 1, "purchase"), (1, "s2", 2, "view"), (2, "s3", 1, "purchase"),
        (2, "s3", 2, None), (3, "s4", 1, "cart"),
    )
    assert rows(quality.units_without_view(df, "user_session")) == [(2,)]
    assert rows(quality.units_without_view(df, "user_id")) == [(1,)]


def test_approximate_counts_are_close(events):
    df = events(*((i % 50, f"s{i}", i, "view") for i in range(500)))
    exact = reports.dataset_summary(df).first()
    rough = reports.dataset_summary(df, approximate=True).first()
    assert (exact.events, exact.users, exact.sessions) == (500, 50, 500)
    assert abs(rough.users - 50) <= 5 and abs(rough.sessions - 500) <= 50
    assert rough.first_event == exact.first_event


def recorded(events):
    draw = random.Random(8)
    rows = [(draw.randrange(60), f"s{i % 9}", i, draw.choice(["view", None])) for i in range(800)]
    rows += [(None, "s", 1, "view", {"product_id": None})] * 3 + [(None, None, 1, "view")] * 2
    rows += rows[:25] + rows[:5] + [(7, "hot", 7, "view")] * 300
    return events(*rows)


@pytest.mark.parametrize("groups", [None, 1, 16])
def test_rows_with_one_fingerprint_are_told_apart(events, rows, monkeypatch, groups):
    df = recorded(events)
    plain = {tuple(r) for r in quality.copies(df).where("cnt > 1").collect()}
    if groups:
        monkeypatch.setattr(quality, "fingerprint", lambda: F.pmod(F.hash("event_ts"), F.lit(groups)).cast("long"))
    assert {tuple(r) for r in quality.duplicate_groups(df).collect()} == plain
    assert rows(quality.redundant_rows(df)) == [(df.count(), sum(r[-1] - 1 for r in plain))]


def test_only_repeated_rows_meet_on_their_columns(events):
    df = recorded(events)
    repeated = quality.copies(df).where("cnt > 1").agg(F.sum("cnt")).first()[0]
    assert quality.suspects(df).count() == repeated < df.count() / 2


def test_too_many_marks_are_not_sent(events, monkeypatch):
    df = recorded(events)
    plain = {tuple(r) for r in quality.duplicate_groups(df).collect()}
    monkeypatch.setattr(quality, "MARKS", 5)
    assert quality.repeated_marks(df) is None
    assert {tuple(r) for r in quality.duplicate_groups(df).collect()} == plain


def test_nothing_repeated(events, rows):
    assert rows(quality.duplicate_groups(events((1, "s", 1, "view")))) == []
    assert rows(quality.redundant_rows(events((1, "s", 1, "view")))) == [(1, 0)]
    assert rows(quality.redundant_rows(events())) == [(0, 0)]
