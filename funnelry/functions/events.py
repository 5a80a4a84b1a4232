"""Expressions over one event row (PRJ-1..6, FLT-1, FLT-8, SCL-1..3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelry.fixed_values import NO_BRAND, UNKNOWN_CATEGORY


def did(kind: str) -> Column:
    """True where the event is of this kind, NULL where its type is unknown (PRJ-1)."""
    return F.col("event_type") == F.lit(kind)


def did_any(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def ones(condition: Column) -> Column:
    """Sum of a condition: 0/1 per row, NULL skipped, NULL over no rows at all."""
    return F.sum(condition.cast("bigint"))


def only_if(kind: str, value: str) -> Column:
    """The value on events of this kind, NULL elsewhere (PRJ-2)."""
    return F.when(did(kind), F.col(value))


def top_category(code: str = "category_code") -> Column:
    """First dotted segment of a category path; missing or empty becomes a label (PRJ-5)."""
    c = F.col(code)
    return F.when(is_blank(code), F.lit(UNKNOWN_CATEGORY)).otherwise(F.substring_index(c, ".", 1))


def brand_label() -> Column:
    """NULL replaced, '' kept (PRJ-6)."""
    return F.coalesce(F.col("brand"), F.lit(NO_BRAND))


def category_label() -> Column:
    """NULL replaced, '' kept (PRJ-6)."""
    return F.coalesce(F.col("category_code"), F.lit(UNKNOWN_CATEGORY))


def is_blank(name: str) -> Column:
    """NULL or empty text; never NULL itself (FLT-8)."""
    return F.col(name).isNull() | (F.col(name) == "")


def has_price() -> Column:
    """A real, positive price (FLT-1). NaN counts as missing, as it does after a load."""
    return (F.col("price") > 0) & ~F.isnan("price")


def lacks_price() -> Column:
    """Missing or non-positive price; never NULL itself (FLT-8)."""
    return F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0)
