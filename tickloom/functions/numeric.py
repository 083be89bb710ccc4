"""Rounding, null policy and normal-distribution helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Fixed digits; NaN and infinities become null."""
    c = F.col(value) if isinstance(value, str) else value
    c = c.cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, F.round(c, digits))


# Published coefficients of rational approximations, highest power first.
# Normal distribution function (G. West, 2005) for |z| under TAIL_FROM; absolute error about 1e-15.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FROM = 7.07106781186547
# Normal quantile (P. Acklam, 2003), relative error 1e-9 before the correcting step.
MIDDLE_TOP = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
MIDDLE_BOTTOM = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
TAIL_BELOW = 0.02425


def _with(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), of), 0)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Probability below z; null stays null."""

    def of(v: Column) -> Column:
        x = F.abs(v)
        fraction = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
        near = _polynomial(CDF_TOP, x) / _polynomial(CDF_BOTTOM, x)
        below = F.exp(-x * x / 2) * F.when(x < TAIL_FROM, near).otherwise(1 / fraction / math.sqrt(2 * math.pi))
        return F.when(v > 0, 1 - below).otherwise(below)

    return _with(z.cast("double"), of)


def normal_quantile(p: Column) -> Column:
    """The value with probability p below it; null outside (0, 1). One Halley step corrects the approximation."""

    def tail(q: Column) -> Column:
        return _with(F.sqrt(-2 * F.log(q)), lambda x: _polynomial(TAIL_TOP, x) / _polynomial(TAIL_BOTTOM, x))

    def middle(q: Column) -> Column:
        return _with(q - 0.5, lambda c: c * _polynomial(MIDDLE_TOP, c * c) / _polynomial(MIDDLE_BOTTOM, c * c))

    def of(q: Column) -> Column:
        first = F.when(q < TAIL_BELOW, tail(q)).when(q > 1 - TAIL_BELOW, -tail(1 - q)).otherwise(middle(q))

        def corrected(x: Column) -> Column:
            return _with((normal_cdf(x) - q) * math.sqrt(2 * math.pi) * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))

        return F.when((q > 0) & (q < 1), _with(first, corrected))

    return _with(p.cast("double"), of)


def corrected_skew(population_skew: Column, n: Column) -> Column:
    """Sample-size corrected skewness from the population moment ratio (null below 3 points)."""
    return F.when(n > 2, population_skew * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_excess_kurtosis(population_excess: Column, n: Column) -> Column:
    """Sample-size corrected excess kurtosis (null below 4 points)."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_excess + 6))
