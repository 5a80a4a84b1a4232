"""Who reached which stage (AGG-1..3, PRJ-3).

A unit (user, session, or either within a segment) reaches a stage if it ever did the action;
order in time does not matter. Steps are conditional: a purchase counts only for a unit that
also viewed and carted.

The stages of a unit are one bit mask, so its aggregate is a single number: map tasks collapse a
unit to one small row by hash before the shuffle. A unit holding a third of all events costs one
row per map task, not a third of the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry.fixed_values import CART, PURCHASE, VIEW
from funnelry.functions.events import did, did_any, ones

STAGES = {"viewed": VIEW, "carted": CART, "purchased": PURCHASE}
BITS = {flag: 1 << i for i, flag in enumerate(STAGES)}


def stage_bit() -> Column:
    """The bit of the event's stage; 0 for other events, NULL where the type is unknown."""
    bit = None
    for flag, kind in STAGES.items():
        value = F.lit(BITS[flag])
        bit = F.when(did(kind), value) if bit is None else bit.when(did(kind), value)
    return bit.when(F.col("event_type").isNotNull(), F.lit(0))


def stage_flags(events: DataFrame, unit: Sequence[str], *extra: Column) -> DataFrame:
    """One row per unit with any extra aggregates and a boolean per stage.

    A flag is NULL, not false, for a unit that has no event of a known type.
    """
    reached = {f: F.col("_stages").bitwiseAND(F.lit(bit)) == bit for f, bit in BITS.items()}
    return (
        events.groupBy(*unit)
        .agg(F.bit_or(stage_bit()).alias("_stages"), *extra)
        .withColumns(reached)
        .drop("_stages")
    )


def step_counts() -> list[Column]:
    """Units at each step, each step requiring the ones before it."""
    viewed, carted, purchased = (F.col(s) for s in STAGES)
    return [
        ones(viewed).alias("step_view"),
        ones(viewed & carted).alias("step_cart"),
        ones(viewed & carted & purchased).alias("step_purchase"),
    ]


def funnel(events: DataFrame, unit: str) -> DataFrame:
    """One row: all units and how many reached each step (AGG-2)."""
    return stage_flags(events, [unit]).agg(F.count(F.lit(1)).alias("total_units"), *step_counts())


def funnel_by(events: DataFrame, segment: str, unit: str = "user_id") -> DataFrame:
    """One row per segment; a unit counts independently in every segment it touched (AGG-3)."""
    return stage_flags(events, [segment, unit]).groupBy(segment).agg(*step_counts())


def relevant_unit(unit: str, *kinds: str) -> Column:
    """The unit on events of these kinds, NULL on all others.

    For counts that look only at units with such an event, the others may share one NULL group:
    it adds 0 to every sum, and a table without such events still sums to 0, not NULL. The
    shuffle then carries only the units that matter.
    """
    return F.when(did_any(*kinds), F.col(unit)).alias(unit)
