"""Distribution functions as column expressions: log gamma, incomplete gamma and beta, and the p-values made from them.

Continued fractions and series are folds over a sequence whose length follows from the parameters, so that a query needs no
Python for its p-values. Nulls and parameters outside a function's domain give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_MANY = 1e6
#: Arguments below this are shifted up before the asymptotic series.
_SHIFT = 16
#: B(2k) / (2k (2k - 1)) of the series of log gamma.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _double(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _rest(z: Column) -> Column:
    """log gamma less its leading terms (z - 1/2) ln z - z + ln(2 pi) / 2, for z from _SHIFT on."""
    out = F.lit(0.0)
    for c in reversed(_SERIES):
        out = out / (z * z) + F.lit(c)
    return out / z


def lgamma(x: Column | float) -> Column:
    """log gamma of x > 0."""
    x = _double(x)
    z = x + _SHIFT
    big = lambda v: (v - 0.5) * F.log(v) - v + 0.5 * math.log(2 * math.pi) + _rest(v)
    product = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0), lambda acc, i: acc * (x + i))
    return F.when(x >= _SHIFT, big(x)).when(x > 0, big(z) - F.log(product))


def lbeta(a: Column | float, b: Column | float) -> Column:
    """log of the beta function, without the cancellation of log gammas where an argument is large."""
    a, b = _double(a), _double(b)
    small, large = F.least(a, b), F.greatest(a, b)
    both = small + large
    grown = (large - 0.5) * F.log1p(small / large) + small * F.log(both) - small + _rest(both) - _rest(large)  # ln G(large + small) - ln G(large)
    return F.when(small > 0, lgamma(small) + F.when(large >= _SHIFT, -grown).otherwise(lgamma(large) - lgamma(both)))


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function (modified Lentz), for x below (a + 1) / (a + b + 2)."""
    n = F.lit(60) + F.ceil(F.lit(4.0) * F.sqrt(F.greatest(a, b))).cast("int")
    start = F.struct(F.lit(1.0).alias("c"), (1 / _away(1 - (a + b) * x / (a + 1))).alias("d"), (1 / _away(1 - (a + b) * x / (a + 1))).alias("h"))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / _away(1 + even * s["d"]), _away(1 + even / s["c"])
        d2, c2 = 1 / _away(1 + odd * d1), _away(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * (d1 * c1) * (d2 * c2)).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["h"])


def _beta(a: Column, b: Column, x: Column, log_x: Column, rest: Column, log_rest: Column) -> Column:
    """The incomplete beta function at x, with rest = 1 - x and both logarithms given, so that neither end loses digits."""
    front = F.exp(a * log_x + b * log_rest - lbeta(a, b))
    direct = front * _beta_fraction(a, b, x) / a
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(1 - front * _beta_fraction(b, a, rest) / b)


def beta_inc(a: Column | float, b: Column | float, x: Column | float) -> Column:
    """Regularised incomplete beta function of x in [0, 1]."""
    a, b, x = _double(a), _double(b), _double(x)
    return F.when((a > 0) & (b > 0) & x.between(0, 1), _beta(a, b, x, F.log(x), 1 - x, F.log1p(-x)))


def gamma_q(a: Column | float, x: Column | float) -> Column:
    """Upper regularised incomplete gamma function of x >= 0."""
    a, x = _double(a), _double(x)
    front = F.exp(a * F.log(x) - x - lgamma(a))
    n = F.lit(120) + F.ceil(F.lit(8.0) * F.sqrt(a)).cast("int")
    series = F.aggregate(
        F.sequence(F.lit(1), n), F.struct((1 / a).alias("term"), (1 / a).alias("sum")),
        lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")), lambda s: s["sum"],
    )
    b0 = x + 1 - a
    start = F.struct(F.lit(1 / _TINY).alias("c"), (1 / _away(b0)).alias("d"), (1 / _away(b0)).alias("h"))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        an, b = -m * (m - a), b0 + 2 * m
        d, c = 1 / _away(an * s["d"] + b), _away(b + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["h"])
    return F.when((a > 0) & (x >= 0), F.when(x == 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction))


def normal_p(z: Column | float) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    z = _double(z)
    return gamma_q(0.5, z * z / 2)


def chi2_p(statistic: Column | float, df: Column | float) -> Column:
    """Probability that a chi-squared variable exceeds the statistic."""
    return gamma_q(_double(df) / 2, _double(statistic) / 2)


def student_p(t: Column | float, df: Column | float) -> Column:
    """Two-sided p-value of Student's t with any positive degrees of freedom; beyond 10^6 of them by the normal statistic
    that differs from it by terms of the order of 1 / df^2."""
    t, df = _double(t), _double(df)
    w = t * t / df
    log_x = -F.log1p(w)
    few = F.when(df <= _MANY, df)  # a fold's length follows from it
    exact = _beta(few / 2, F.lit(0.5), 1 / (1 + w), log_x, w / (1 + w), F.log(w) + log_x)
    near = normal_p((df - 2 / 3 + 1 / (10 * df)) * F.sqrt(F.log1p(w) / (df - 5 / 6)))
    return F.when(df > 0, F.when(t == 0, 1.0).when(df > _MANY, near).otherwise(exact))


def erfc(x: Column | float) -> Column:
    x = _double(x)
    tail = gamma_q(0.5, x * x)
    return F.when(x >= 0, tail).otherwise(2 - tail)
