"""Exact quantiles of Beta distributions as column expressions.

The distribution function is a series of positive terms, added up in ``aggregate``; its inverse is
Newton's method kept inside a bracket. Nothing leaves the JVM. What does not
converge is an error, never a wrong number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term below this share of the sum ends the series; the last one that is taken must be.
_SMALLEST_TERM = 1e-13
#: Newton steps; each at least halves the bracket where it doesn't do better.
_STEPS = 40
_TOLERANCE = 1e-10
# coefficients of Stirling's series
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 10


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for ``z > 0``: Stirling's series, ten steps up."""
    product = z
    for k in range(1, _SHIFT):
        product = product * (z + k)
    high = z + _SHIFT
    series = F.lit(0.0)
    for k, c in enumerate(_STIRLING):
        series = series + F.lit(c) / F.pow(high, F.lit(float(2 * k + 1)))
    return (high - 0.5) * F.log(high) - high + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def _series(x: Column, a: Column, b: Column) -> Column:
    """Sum of ``x^n (a+b)...(a+b+n-1) / ((a+1)...(a+n))``; raises an error unless it has converged."""
    terms = F.sequence(F.lit(1), F.ceil(60 + 24 * F.sqrt(a + b)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x * (a + b + n - 1) / (a + n)
        more = F.struct(term.alias("term"), (s["total"] + term).alias("total"))
        return F.when(s["term"] <= _SMALLEST_TERM * s["total"], s).otherwise(more)

    def end(s: Column) -> Column:
        message = F.lit("the series of a Beta distribution has not converged")
        return F.when(s["term"] <= _SMALLEST_TERM * s["total"], s["total"]).otherwise(F.raise_error(message).cast("double"))

    return F.aggregate(terms, start, add, end)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function; ``a`` and ``b`` positive, NULL where any argument is."""
    # the series converges slowly near 1; that half is mirrored
    below = x <= 0.5
    arguments = F.struct(
        F.when(below, x).otherwise(1.0 - x).alias("x"), F.when(below, a).otherwise(b).alias("a"), F.when(below, b).otherwise(a).alias("b")
    )

    def lower(v: Column) -> Column:
        front = F.exp(v["a"] * F.log(v["x"]) + v["b"] * F.log1p(-v["x"]) - log_beta(v["a"], v["b"])) / v["a"]
        return front * _series(v["x"], v["a"], v["b"])

    part = _let(arguments, lower)
    inside = F.when(below, part).otherwise(1.0 - part)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def beta_quantile(p: float, a: Column, b: Column) -> Column:
    """The ``x`` with ``beta_cdf(x, a, b) = p`` for ``0 < p < 1``."""
    mean = a / (a + b)
    # the constant of the density is worked out once, not in every step
    start = F.struct(mean.alias("x"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), log_beta(a, b).alias("c"), F.lit(1.0).alias("miss"))

    def step(s: Column, _: Column) -> Column:
        def moved(miss: Column) -> Column:
            low = F.when(miss < 0, s["x"]).otherwise(s["low"])
            high = F.when(miss < 0, s["high"]).otherwise(s["x"])
            density = F.exp((a - 1) * F.log(s["x"]) + (b - 1) * F.log1p(-s["x"]) - s["c"])
            newton = s["x"] - miss / density
            inside = (newton > low) & (newton < high)
            x = F.when(F.abs(miss) <= _TOLERANCE / 100, s["x"]).when(inside, newton).otherwise((low + high) / 2)
            return F.struct(x.alias("x"), low.alias("low"), high.alias("high"), s["c"].alias("c"), F.abs(miss).alias("miss"))

        settled = s["miss"] <= _TOLERANCE / 100
        return F.when(settled, s).otherwise(_let(beta_cdf(s["x"], a, b) - p, moved))

    def end(s: Column) -> Column:
        message = F.lit("a quantile of a Beta distribution has not converged")
        return F.when(s["miss"] <= _TOLERANCE, s["x"]).otherwise(F.raise_error(message).cast("double"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, end)
