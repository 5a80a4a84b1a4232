"""Rounding, guarded ratios and bucket labels (PRJ-7, PRJ-10, SCL-4..6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelry.fixed_values import QUARTILE_LABEL


def round_to(value: Column, digits: int) -> Column:
    """Round half up as a person reads the number: 1.005 to two digits is 1.01.

    Going through DECIMAL drops the last-bit noise of a double average, which would otherwise
    decide ties. Values outside DECIMAL(38,10) fall back to the plain double rounding.
    """
    exact = F.round(value.try_cast("decimal(38,10)"), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def ratio(numerator: Column, denominator: Column) -> Column:
    """a / b in double, NULL where b is 0 or NULL; never an ANSI error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return round_to(ratio(F.lit(100.0) * part, whole), digits)


def bucket_label(value: Column, table: Sequence[tuple[int | None, str]]) -> Column:
    """The label of the first exclusive upper bound above the value (PRJ-7)."""
    *bounded, (_, rest) = table
    label = None
    for bound, text in bounded:
        hit = value < F.lit(bound)
        label = F.when(hit, F.lit(text)) if label is None else label.when(hit, F.lit(text))
    return label.otherwise(F.lit(rest))


def quartile_label(quartile: Column, low: Column, high: Column) -> Column:
    """'Q2 ($15–$34)'; whole amounts rounded half to even (PRJ-10)."""
    return F.format_string(QUARTILE_LABEL, quartile, F.bround(low, 0), F.bround(high, 0))
