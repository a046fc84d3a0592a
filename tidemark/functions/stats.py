"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps by which the argument of a gamma ratio is moved up before its asymptotic series is used.
_UP = 64


def log_gamma_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0, to some 1e-13."""
    z = a + _UP
    series = F.log(z) / 2 + F.log1p(-1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * z * z * z) - 21 / (32768 * z * z * z * z))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(_UP - 1)), F.lit(0.0), lambda s, k: s + F.log((a + k) / (a + k + 0.5)))
    return series + down


def _fraction(x: Column, a: Column, b: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its end."""

    def part(f: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even, odd = m * (b - m), -(a + m) * (a + b + m)
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) * x / ((a + k - 1) * (a + k)) / f

    return 1 / F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), F.lit(1.0), part)


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided p of a correlation over n rows by Student's t with n - 2 degrees: the incomplete beta function at
    1 - rho**2.  Null where rho is null or there are fewer than five rows; 0 where rho is 1 or -1."""
    a, b, x = (n - 2).cast("double") / 2, F.lit(0.5), 1 - rho * rho
    steps = (F.lit(80) + 20 * F.sqrt(a)).cast("int")  # terms grow with the root of the larger parameter
    front = F.exp(a * F.log(x) + b * F.log(rho * rho) + log_gamma_step(a)) / math.sqrt(math.pi)
    near = front / a * _fraction(x, a, b, steps)
    far = 1 - front / b * _fraction(1 - x, b, a, steps)
    p = F.when(F.abs(rho) >= 1, 0.0).when(rho == 0, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)
    return F.when(rho.isNull() | F.isnan(rho) | (n < 5), F.lit(None).cast("double")).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
