"""Scalar expressions that Spark lacks, all as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_round(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal, from a published rational approximation of erfc (error below 1.2e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + x / 2)
    # Coefficients of the approximation, highest power first.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    erfc = t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = 2 * math.pi * c / period
    return F.sin(angle), F.cos(angle)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def corrected_skewness(c: Column) -> Column:
    """Sample skewness, corrected for bias; an aggregate. Null for fewer than 3 values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def corrected_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis, corrected for bias; an aggregate. Null for fewer than 4 values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
