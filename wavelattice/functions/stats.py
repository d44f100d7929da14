"""Distribution functions as column expressions (Spark SQL has none)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_upper_quantile(p: Column) -> Column:
    """z with P(Z > z) = p for 0 < p <= 1/2, by a rational approximation (error below 5e-4)."""
    t = F.sqrt(-2.0 * F.log(p))
    above = F.lit(2.515517) + F.lit(0.802853) * t + F.lit(0.010328) * t * t
    below = F.lit(1.0) + F.lit(1.432788) * t + F.lit(0.189269) * t * t + F.lit(0.001308) * t * t * t
    return t - above / below


def student_upper_quantile(p: Column, df: Column) -> Column:
    """t with P(T > t) = p, by the expansion in 1/df around the normal quantile."""
    z = normal_upper_quantile(p)
    z3, z5 = F.pow(z, F.lit(3)), F.pow(z, F.lit(5))
    return z + (z3 + z) / (4 * df) + (5 * z5 + 16 * z3 + 3 * z) / (96 * df * df)


def esd_limit(n: Column, i: Column, alpha: float) -> Column:
    """Critical value of the i-th step of the generalised extreme studentised deviate test on n values.

    Null where no degree of freedom is left (i >= n - 1): a division by zero there is an error in ANSI mode.
    """
    p = F.lit(alpha) / (2 * (n - i + 1))
    df = F.when(n - i > 1, n - i - 1)
    t = student_upper_quantile(p, df)
    return (n - i) * t / F.sqrt((df + t * t) * (n - i + 1))
