"""Normal and chi-square probabilities as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import Column
from pyspark.sql import functions as F

# erfc(x) = t * exp(g(t) - x^2) with t = 2 / (2 + x); g is smooth, so a polynomial carries it
LARGEST = 26.0
_T_LOW = 2.0 / (2.0 + LARGEST)
_DEGREE = 32


def _g(y: np.ndarray) -> np.ndarray:
    t = _T_LOW + (np.asarray(y) + 1.0) * (1.0 - _T_LOW) / 2.0
    x = 2.0 / t - 2.0
    return np.array([math.log(math.erfc(v) / u) + v * v for v, u in zip(x, t)])


_COEFFICIENTS = chebyshev.cheb2poly(chebyshev.chebinterpolate(_g, _DEGREE))[::-1]


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def erfc(c: Column) -> Column:
    """Complementary error function; Spark SQL has none, and this one stays in the JVM."""
    x = F.abs(c.cast("double"))
    t = F.lit(2.0) / (F.lit(2.0) + x)
    y = (t - F.lit(_T_LOW)) * F.lit(2.0 / (1.0 - _T_LOW)) - F.lit(1.0)
    g = F.aggregate(
        F.array(*[F.lit(float(v)) for v in _COEFFICIENTS]), F.lit(0.0), lambda s, k: s * y + k
    )
    upper = F.when(x > LARGEST, F.lit(0.0)).otherwise(t * F.exp(g - x * x))
    return F.when(c < 0, F.lit(2.0) - upper).when(c.isNotNull(), upper)


def normal_cdf(c: Column) -> Column:
    return F.lit(0.5) * erfc(-c / F.lit(math.sqrt(2.0)))


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_sf(x: Column, df: int = 1) -> Column:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom."""
    if df < 1:
        return F.lit(None).cast("double")
    half = x.cast("double") / F.lit(2.0)
    if df % 2:
        tail, power = erfc(F.sqrt(half)), 0.5
    else:
        tail, power = F.exp(-half), 1.0
    while power < df / 2.0:
        tail = tail + F.exp(-half) * F.pow(half, F.lit(power)) / F.lit(math.gamma(power + 1.0))
        power += 1.0
    return tail
