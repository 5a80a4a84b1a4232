"""Units that put something in the cart and never bought (AGG-11, AGG-12, PRJ-4).

A carter needs no recorded view, so these denominators differ from the funnel's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.fixed_values import CART, PURCHASE
from funnelry.functions.events import ones
from funnelry.operators.funnel import relevant_unit, stage_flags

def abandoned_counts() -> list[Column]:
    """Carters and abandoned carts out of unit flags; NULL over no units at all."""
    carted, purchased = F.col("carted"), F.col("purchased")
    return [ones(carted).alias("carters"), ones(carted & ~purchased).alias("abandoned")]


def abandonment(events: DataFrame, unit: str) -> DataFrame:
    """One row: carters and those of them without a purchase."""
    rows = events.select(relevant_unit(unit, CART, PURCHASE), "event_type")
    return stage_flags(rows, [unit]).agg(*abandoned_counts())


def abandonment_by(events: DataFrame, segment: str, unit: str = "user_id") -> DataFrame:
    """The same per segment; a purchase counts only inside its own segment."""
    rows = events.select(segment, relevant_unit(unit, CART, PURCHASE), "event_type")
    return stage_flags(rows, [segment, unit]).groupBy(segment).agg(*abandoned_counts())
