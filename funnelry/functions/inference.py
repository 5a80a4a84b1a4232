"""Intervals and tests on counted proportions, as column expressions (STAT-1, STAT-2, SCL-11).

An undefined result is NULL. Spark has no function for the two tail probabilities; they are summed up
here as series and continued fractions over short sequences, so that no row leaves the JVM. Each is
summed from the side where all terms have one sign: their digits hold far out in a tail, where
1 - CDF would be 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelry.fixed_values import ALPHA
from funnelry.functions.numbers import ratio


def wilson_interval(k: Column, n: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """Score interval of k successes in n trials, inside [0, 1]; (0, 0) without trials."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p = ratio(k, n)
    shrink = F.lit(1.0) + ratio(F.lit(z * z), n)
    middle = (p + ratio(F.lit(z * z / 2), n)) / shrink
    spread = ratio(p * (F.lit(1.0) - p), n) + ratio(F.lit(z * z / 4), n.cast("double") * n)
    reach = F.lit(z) * F.sqrt(spread) / shrink

    def known(bound: Column) -> Column:
        return F.when(n > 0, bound).when(n == 0, F.lit(0.0))

    return (
        known(F.greatest(F.lit(0.0), middle - reach)),
        known(F.least(F.lit(1.0), middle + reach)),
    )


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """z of rate 1 against rate 2 under a pooled rate.

    Undefined if either group is empty or if nobody, or everybody, converts.
    """
    k, n = k1 + k2, n1 + n2
    pooled = ratio(k, n)
    variance = pooled * (F.lit(1.0) - pooled) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2))
    testable = (n1 > 0) & (n2 > 0) & (k > 0) & (k < n)
    return F.when(testable, ratio(ratio(k1, n1) - ratio(k2, n2), F.sqrt(variance)))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)), z * z / F.lit(2.0))


#: From here on erfc is a continued fraction, below it 1 minus a series; steps that either takes.
FRACTION_FROM, FRACTION_STEPS, SERIES_STEPS = 2.0, 90, 60


def erfc(t: Column, squared: Column) -> Column:
    """Complementary error function of t >= 0; `squared` is its square, known better than from t."""
    steps = F.sequence(F.lit(FRACTION_STEPS), F.lit(1), F.lit(-1))
    fraction = F.aggregate(steps, t, lambda f, k: t + k / F.lit(2.0) / f)
    far = F.exp(-squared - F.log(fraction * F.lit(math.sqrt(math.pi))))
    sums = _summed(F.sequence(F.lit(1), F.lit(SERIES_STEPS)), lambda k: squared / (k + F.lit(0.5)))
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * t * F.exp(-squared) * sums
    return F.when(t >= FRACTION_FROM, far).when(t >= 0, near)


def _summed(steps: Column, factor: Callable[[Column], Column]) -> Column:
    """1 + f(s1) + f(s1) f(s2) + ... over the steps s1, s2, ..."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(so_far: Column, step: Column) -> Column:
        term = so_far["term"] * factor(step.cast("double"))
        return F.struct(term.alias("term"), (so_far["sum"] + term).alias("sum"))

    return F.aggregate(steps, start, add, lambda so_far: so_far["sum"])


#: Stirling's series for the logarithm of the gamma function, from STIRLING_FROM on.
STIRLING_FROM = 10
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def poisson_term(s: Column, h: Column) -> Column:
    """h ** s * exp(-h) / gamma(s + 1) for s = 0, 1/2, 1, ... and h > 0."""
    values = (math.gamma(n / 2 + 1) for n in range(2 * STIRLING_FROM))
    gammas = F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")
    small = F.pow(h, s) * F.exp(-h) / F.element_at(gammas, (s * 2).cast("int") + 1)
    # In logarithms, as a distance from the largest term, so that large numbers do not cancel.
    off = (h - s) / s
    rest = F.lit(0.0)
    for c in reversed(STIRLING):
        rest = rest / (s * s) + F.lit(c)
    large = F.exp(-s * (off - F.log1p(off)) - rest / s) / F.sqrt(F.lit(2 * math.pi) * s)
    return F.when(s < STIRLING_FROM, small).otherwise(large)


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of chi-square for a whole number of degrees of freedom.

    With a = df / 2 and h = x / 2 it is a finite sum of Poisson terms below a, for odd `df` after
    the normal tail; for h below a it is 1 minus the terms from a on. Either is summed from its
    largest term, as far as terms can count.
    """
    a, h = df.cast("double") / 2, x.cast("double") / 2
    enough = F.ceil(F.lit(SERIES_STEPS) + F.sqrt(a) * 10).cast("int")
    upward = _summed(F.sequence(F.lit(1), enough), lambda n: h / (a + n))
    terms = F.floor(a).cast("int")
    more = F.greatest(F.least(terms - 1, enough), F.lit(0))
    steps = F.slice(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), F.lit(1), more)
    downward = poisson_term(F.greatest(a - 1, F.lit(0.0)), h) * _summed(steps, lambda n: (a - n) / h)
    start = F.when(terms < a, erfc(F.sqrt(h), h)).otherwise(0.0)
    beyond = start + F.when(terms > 0, downward).otherwise(0.0)
    tail = F.when(h < a, F.lit(1.0) - poisson_term(a, h) * upward).otherwise(F.least(F.lit(1.0), beyond))
    known = x.isNotNull() & df.isNotNull() & ~F.isnan(x.cast("double"))
    return F.when(known & (x <= 0), F.lit(1.0)).when(known, tail)
