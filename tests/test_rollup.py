"""Reports read from the stored summary equal those over the events."""

import pytest

from funnelry.plans import rollup
from funnelry.plans.reports import REPORTS

ROWS = [
    (1, "s1", 1, "view"), (1, "s1", 9, "purchase"), (1, "s2", 100_000, "cart"),
    (2, "s3", 5, "view"), (2, "s4", 90_005, "purchase"), (3, "s5", 1, "purchase"),
    # One session id shared by two users.
    (4, "s6", 1, "view"), (5, "s6", 700, "purchase"), (6, "s7", 1, None), (6, "s7", 1, "wishlist"),
]


@pytest.mark.parametrize("name", rollup.ROLLUP_REPORTS)
def test_same_as_over_events(spark, events, rows, tmp_path, name):
    df = events(*ROWS)
    stored = rollup.store_rollup(df, str(tmp_path / "rollup"))
    assert rows(rollup.ROLLUP_REPORTS[name](stored)) == rows(REPORTS[name](df))


@pytest.mark.parametrize("name", rollup.ROLLUP_REPORTS)
def test_same_on_an_empty_table(events, rows, name):
    df = events()
    assert rows(rollup.ROLLUP_REPORTS[name](rollup.session_rollup(df))) == rows(REPORTS[name](df))
