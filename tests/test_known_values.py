"""Results over the given tables that were worked out beforehand, independently of both engines."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from funnelry.plans.reports import REPORTS
from funnelry.sources.driver_events import clickstream

KNOWN = {
    "funnel_user": [(450, 437, 225, 113)],
    "funnel_session": [(4006, 3827, 260, 20)],
    "funnel_by_category": [
        ("electronics", 431, 75, 15), ("apparel", 430, 61, 5), ("(unknown)", 428, 71, 13),
        ("auto", 394, 24, 0), ("computers", 388, 18, 0), ("furniture", 388, 16, 0),
        ("appliances", 376, 12, 1),
    ],
    "funnel_by_price_quartile": [
        (1, 0.01, 14.59, 434, 70, 10), (2, 14.59, 34.5, 435, 75, 10),
        (3, 34.51, 69.12, 434, 65, 13), (4, 69.14, 490.02, 435, 64, 10),
    ],
    "time_to_convert": [("same session", 165, 97.41), ("later return (> 1 day)", 23, 110.53)],
    "abandonment_overall": [("per user", 225, 112), ("per session", 292, 267)],
    "dataset_summary": [
        (10050, 450, 4006, "2024-01-01 00:00:07 UTC", "2024-01-30 23:57:12 UTC")
    ],
}
HISTOGRAMS = {"lag_event_gaps": [50, 15, 127, 309, 8142, 957]}


@pytest.fixture(scope="module")
def shop(spark):
    return clickstream(spark, str(DATA / "sf0.01"))


@pytest.mark.parametrize("name", KNOWN)
def test_report(shop, rows, name):
    how = {"tiebreak": ["event_id"]} if name == "funnel_by_price_quartile" else {}
    assert rows(REPORTS[name](shop, **how)) == KNOWN[name]


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_histogram(shop, rows, name):
    assert [r[2] for r in rows(REPORTS[name](shop))] == HISTOGRAMS[name]


def test_data_quality(shop, rows):
    values = [value for _, value, _ in rows(REPORTS["data_quality"](shop))]
    assert values == [10050, 1960, 3351, 336, 50, 152, 13]


def test_counts_add_up(shop):
    total, sessions = 10050, 4006
    assert sum(r.sessions for r in REPORTS["events_per_session"](shop).collect()) == sessions
    assert sum(r.sessions for r in REPORTS["session_duration"](shop).collect()) == sessions
    gaps = REPORTS["lag_event_gaps"](shop).collect()
    assert sum(r.gap_count for r in gaps) == total - 450


def test_steps_never_grow(shop):
    for name in ("funnel_user", "funnel_session"):
        r = REPORTS[name](shop).first()
        assert r.step_purchase <= r.step_cart <= r.step_view <= r.total_units


def test_orders_as_a_clickstream(spark, rows):
    """Another table: an order is a session, a line an action, its return flag the stage."""
    read = lambda name: spark.read.parquet(str(DATA / "sf0.01" / f"{name}.parquet"))
    stages = F.create_map(*(F.lit(v) for pair in zip("NAR", ("view", "cart", "purchase")) for v in pair))
    lines = (
        read("lineitem")
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").cast("string").alias("user_session"),
            stages[F.col("l_returnflag")].alias("event_type"),
        )
    )
    assert rows(REPORTS["funnel_user"](lines)) == [(1500, 1499, 1498, 1495)]
    assert rows(REPORTS["funnel_session"](lines)) == [(14743, 11062, 8102, 6003)]
