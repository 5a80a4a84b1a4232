"""Comparing conversion across segments (STAT-3..13, JOIN-2, AGG-22, FLT-9, FLT-10).

Input is a table of counted segments: `segment`, a `position` for reading order, and the three
step counts. "The rest" of a segment are the other rows of this table, so whatever a report cut
off takes no part. Units may sit in several segments; like any such per-segment test these
treat the segments as independent samples.

Totals are a grouped aggregate joined back on the step. That side has one row per step, two at
most, so it is broadcast; the segments themselves are never brought together in one task. Both
sides of that join read the same segments, and Spark computes them once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelry import fixed_values as fv
from funnelry.functions.events import ones
from funnelry.functions.inference import chi2_p, two_proportion_z, two_sided_p, wilson_interval
from funnelry.functions.numbers import ratio

# Step -> (units that took it, units that could have).
STEPS = {
    fv.VIEW_TO_CART: ("step_cart", "step_view"),
    fv.CART_TO_PURCHASE: ("step_purchase", "step_cart"),
}


def step_trials(segments: DataFrame, steps: Sequence[str] = tuple(STEPS)) -> DataFrame:
    """(segment, position, step, k, n): one row per segment and step (STAT-13)."""
    cells = [
        F.struct(
            F.lit(step).alias("step"),
            F.col(STEPS[step][0]).alias("k"),
            F.col(STEPS[step][1]).alias("n"),
        )
        for step in steps
    ]
    return segments.select("segment", "position", F.inline(F.array(*cells)))


def _with_totals(trials: DataFrame) -> DataFrame:
    totals = trials.groupBy("step").agg(
        F.sum("k").alias("all_k"),
        F.sum("n").alias("all_n"),
        # Rows, whatever their labels. It looks at the label all the same: a plain count would let
        # Spark prune the labels from this side only, and then the two sides could no longer
        # share the work on the events.
        F.sum(F.when(F.length(F.coalesce("segment", F.lit(""))) >= 0, 1)).alias("n_tests"),
        ones(F.col("n") > 0).alias("groups"),
    )
    return trials.join(F.broadcast(totals), "step")


def homogeneity(trials: DataFrame, alpha: float = fv.ALPHA) -> DataFrame:
    """Chi-square over all segments, one row per step (STAT-3, STAT-12).

    Empty segments are left out. Two segments get the continuity correction. Undefined with
    fewer than two segments or if nobody, or everybody, converts. `valid` says that every
    expected count is large enough for the tail to be trusted.
    """
    k, n, all_k, all_n = (F.col(c).cast("double") for c in ("k", "n", "all_k", "all_n"))
    hit = ratio(n * all_k, all_n)
    miss = ratio(n * (all_n - all_k), all_n)
    distance = F.abs(k - hit)
    moved = F.when(F.col("groups") == 2, F.greatest(distance - 0.5, F.lit(0.0))).otherwise(distance)
    usable = (n > 0) & (F.col("groups") >= 2) & (all_k > 0) & (all_k < all_n)
    cells = moved * moved * (ratio(F.lit(1.0), hit) + ratio(F.lit(1.0), miss))
    return (
        _with_totals(trials)
        .groupBy("step")
        .agg(
            F.sum(F.when(usable, cells)).alias("chi2"),
            F.max(F.when(usable, F.col("groups") - 1)).alias("df"),
            F.min(F.when(usable, F.least(hit, miss))).alias("smallest"),
        )
        .withColumn("p_value", chi2_p(F.col("chi2"), F.col("df")))
        .select(
            "step",
            "chi2",
            "df",
            "p_value",
            F.coalesce(F.col("smallest") >= fv.MIN_EXPECTED, F.lit(False)).alias("valid"),
            F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("differs"),
            F.coalesce(F.col("smallest") < fv.MIN_EXPECTED, F.lit(False)).alias("approximate"),
        )
    )


def versus_rest(trials: DataFrame, alpha: float = fv.ALPHA) -> DataFrame:
    """Every segment against all others together, one row per segment and step (STAT-4..6).

    The corrected threshold divides alpha by all segments of the step, testable or not.
    """
    k, n = F.col("k"), F.col("n")
    rest_k, rest_n = F.col("all_k") - k, F.col("all_n") - n
    low, high = wilson_interval(k, n, alpha)
    return (
        _with_totals(trials)
        .select(
            "segment",
            "position",
            "step",
            "n",
            ratio(k, n).alias("rate"),
            (ratio(k, n) - ratio(rest_k, rest_n)).alias("rate_vs_rest"),
            low.alias("ci_low"),
            high.alias("ci_high"),
            two_proportion_z(k, n, rest_k, rest_n).alias("z"),
            "n_tests",
            ratio(F.lit(alpha), F.col("n_tests")).alias("bonferroni_alpha"),
        )
        .withColumn("p_value", two_sided_p(F.col("z")))
        .withColumn("verdict", verdict(F.col("p_value"), F.col("bonferroni_alpha"), alpha))
    )


def verdict(p: Column, corrected: Column, alpha: float = fv.ALPHA) -> Column:
    """What to conclude from a p-value; both thresholds are strict (STAT-6)."""
    return (
        F.when(p.isNull(), fv.NOT_TESTABLE)
        .when(p < corrected, fv.SIGNIFICANT)
        .when(p < alpha, fv.BORDERLINE)
        .otherwise(fv.NO_EVIDENCE)
    )


def significant_names(tests: DataFrame) -> DataFrame:
    """The surviving segments of each step as one text, in reading order (FLT-10).

    Meant for the reports' segments, which a limit or the number of quartiles bounds.
    """
    kept = F.when(F.col("verdict") == fv.SIGNIFICANT, F.struct("position", "segment"))
    names = F.transform(F.sort_array(F.collect_list(kept)), lambda s: s["segment"])
    return tests.groupBy("step").agg(
        ones(F.col("verdict") == fv.SIGNIFICANT).alias("significant"),
        F.concat_ws(", ", names).alias("segments"),
    )


def rate_series(trials: DataFrame) -> DataFrame:
    """Conversion in percent with the lengths of its error bars (STAT-9); 0 without trials."""
    rate = F.coalesce(ratio(F.col("k"), F.col("n")), F.lit(0.0))
    low, high = wilson_interval(F.col("k"), F.col("n"))
    return trials.select(
        "segment",
        "position",
        "step",
        (rate * 100.0).alias("rate_pct"),
        ((rate - low) * 100.0).alias("err_minus"),
        ((high - rate) * 100.0).alias("err_plus"),
    )


def funnel_steps(funnel: DataFrame) -> DataFrame:
    """A one-row funnel as three step rows with rates and intervals (STAT-7, STAT-8, STAT-10)."""
    view, cart, purchase = (F.col(c) for c in ("step_view", "step_cart", "step_purchase"))
    steps = ((fv.STEP_VIEWED, view, view), (fv.STEP_CARTED, cart, view),
             (fv.STEP_PURCHASED, purchase, cart))
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("step_no"), F.lit(name).alias("step"), k.alias("k"), n.alias("n")
            )
            for i, (name, k, n) in enumerate(steps, 1)
        )
    )
    low, high = wilson_interval(F.col("k"), F.col("n"))
    return funnel.select(
        F.inline(rows), ratio(purchase, view).alias("end_to_end")
    ).select(
        "step_no",
        "step",
        "k",
        "n",
        ratio(F.col("k"), F.col("n")).alias("rate"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        (ratio(F.col("k"), F.col("n")) * 100.0).alias("pct_previous"),
        "end_to_end",
    )


def abandonment_rates(counts: DataFrame) -> DataFrame:
    """Share of carters that abandoned, with its interval (STAT-11)."""
    k, n = F.col("abandoned"), F.col("carters")
    low, high = wilson_interval(k, n)
    return counts.withColumns({"rate": ratio(k, n), "ci_low": low, "ci_high": high})
