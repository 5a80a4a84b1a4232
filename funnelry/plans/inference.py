"""The statistical reports: named reports with judgement attached (STAT-3..13, FLT-10)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry.functions.numbers import quartile_label
from funnelry.operators import segments as seg
from funnelry.operators.ntile import Border
from funnelry.plans import reports

CATEGORY = "category"
PRICE = "price"
STEP_COLUMNS = ("step_view", "step_cart", "step_purchase")


def category_segments(events: DataFrame) -> DataFrame:
    """The category funnel as segments, most viewed first."""
    return reports.funnel_by_category(events).select(
        F.col("top_category").alias("segment"), (-F.col("step_view")).alias("position"), *STEP_COLUMNS
    )


def price_segments(
    events: DataFrame, tiebreak: Sequence[str] = (), borders: Sequence[Border] | None = None
) -> DataFrame:
    """The price funnel as segments labelled by their price range, cheapest first (PRJ-10).

    Every call without `borders` searches for them; `reports.price_borders` does it once for many.
    """
    quartile = F.col("price_quartile")
    label = quartile_label(quartile, F.col("price_min"), F.col("price_max"))
    return reports.price_quartiles(events, tiebreak, borders=borders).select(
        label.alias("segment"), quartile.cast("bigint").alias("position"), *STEP_COLUMNS
    )


def splits(
    tiebreak: Sequence[str] = (), borders: Sequence[Border] | None = None
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    by_price = lambda events: price_segments(events, tiebreak, borders)
    return {CATEGORY: category_segments, PRICE: by_price}


def funnel_steps_user(events: DataFrame) -> DataFrame:
    return seg.funnel_steps(reports.funnel_user(events))


def funnel_steps_session(events: DataFrame) -> DataFrame:
    return seg.funnel_steps(reports.funnel_session(events))


def abandonment_rates(events: DataFrame) -> DataFrame:
    return seg.abandonment_rates(reports.abandonment_overall(events))


def segment_rate_series(
    events: DataFrame,
    split: str,
    tiebreak: Sequence[str] = (),
    borders: Sequence[Border] | None = None,
) -> DataFrame:
    return seg.rate_series(seg.step_trials(splits(tiebreak, borders)[split](events)))


def segment_homogeneity(
    events: DataFrame,
    split: str,
    step: str,
    tiebreak: Sequence[str] = (),
    borders: Sequence[Border] | None = None,
) -> DataFrame:
    return seg.homogeneity(seg.step_trials(splits(tiebreak, borders)[split](events), [step]))


def segment_tests(
    events: DataFrame,
    split: str,
    step: str,
    tiebreak: Sequence[str] = (),
    borders: Sequence[Border] | None = None,
) -> DataFrame:
    return seg.versus_rest(seg.step_trials(splits(tiebreak, borders)[split](events), [step]))


def significant_segments(
    events: DataFrame, tiebreak: Sequence[str] = (), borders: Sequence[Border] | None = None
) -> DataFrame:
    """For every split and step, which segments really differ."""
    by_split = [
        seg.significant_names(seg.versus_rest(seg.step_trials(find(events)))).select(
            F.lit(name).alias("split"), "step", "significant", "segments"
        )
        for name, find in splits(tiebreak, borders).items()
    ]
    return by_split[0].unionByName(by_split[1])
