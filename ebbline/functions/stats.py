"""Normal-distribution functions as column expressions."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Chebyshev fit to the complementary error
# function in Press et al., Numerical Recipes (relative error below 1.2e-7).
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc_positive(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1 / (1 + x / 2)
    poly = reduce(
        lambda acc, c: F.lit(c) + t * acc,
        reversed(ERFC_COEFFICIENTS[:-1]),
        F.lit(ERFC_COEFFICIENTS[-1]),
    )
    return t * F.exp(-x * x + poly)


def two_sided_p(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z."""
    return erfc_positive(F.abs(z) / F.sqrt(F.lit(2.0)))


def normal_cdf(z: Column) -> Column:
    upper = erfc_positive(F.abs(z) / F.sqrt(F.lit(2.0))) / 2
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
