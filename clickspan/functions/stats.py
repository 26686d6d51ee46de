"""Closed-form statistics as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26: rational approximation of erf, |error| <= 1.5e-7 (fixed values).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc_positive(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail probability."""
    return erfc_positive(F.abs(z) / F.sqrt(F.lit(2.0)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 for an empty denominator."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
