"""Rounding and the normal distribution, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 of nothing is 0."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def ratio(a: Column, b: Column, none: float | None = None) -> Column:
    """a / b, or none where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(none).cast("double"))


# Coefficients of the rational approximation 7.1.26 of the error function in the Handbook of Mathematical Functions.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to 1e-7."""
    x = F.abs(z) / (2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def normal_cdf_sql(z: str) -> str:
    """The same in SQL."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    poly = "0.0"
    for c in reversed(ERF):
        poly = f"(({poly} + ({c})) * {t})"
    erf = f"(1 - {poly} * exp(-(abs({z}) / sqrt(2.0)) * (abs({z}) / sqrt(2.0))))"
    return f"(CASE WHEN {z} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


def clock_text(seconds: Column) -> Column:
    """Seconds as "Mm SSs"; halves of a second to the even one."""
    total = F.bround(seconds, 0).cast("long")
    return F.format_string("%dm %02ds", F.floor(total / 60), total % 60)
