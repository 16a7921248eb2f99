"""Tail probabilities as Column expressions.

They are evaluated on result rows (one per feature), so a fixed number of series terms is cheap. The
series and continued fractions are the textbook ones; which is used depends on where it converges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last))


def _erfc_series(x: Column) -> Column:
    """1 - erf(x) by the all-positive series; accurate below about 2."""
    square = x * x
    total = F.aggregate(
        _steps(1, 60),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] * 2.0 * square / (2.0 * k + 1.0)).alias("term"),
            (acc["sum"] + acc["term"] * 2.0 * square / (2.0 * k + 1.0)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return 1.0 - total * F.exp(-square) * (2.0 / math.sqrt(math.pi))


def _erfc_fraction(x: Column) -> Column:
    """erfc(x) by its continued fraction; keeps relative accuracy in the far tail."""
    denominator = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, k: x + (k / 2.0) / acc
    )
    return F.exp(-x * x) / (denominator * math.sqrt(math.pi))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    x = F.abs(z) / math.sqrt(2.0)
    near, far = F.least(x, F.lit(2.0)), F.greatest(x, F.lit(2.0))
    return F.when(x < 2.0, _erfc_series(near)).when(x >= 2.0, _erfc_fraction(far))


def kolmogorov_tail(lam: Column) -> Column:
    """P(K >= lam) for the Kolmogorov distribution."""
    safe = F.greatest(lam, F.lit(1e-3))
    direct = F.aggregate(
        _steps(1, 20),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * safe * safe),
    )
    dual = F.aggregate(
        _steps(1, 20),
        F.lit(0.0),
        lambda acc, k: acc
        + F.exp(-(2.0 * k - 1.0) * (2.0 * k - 1.0) * (math.pi**2 / 8.0) / (safe * safe)),
    )
    below = 1.0 - F.lit(math.sqrt(2.0 * math.pi)) / safe * dual
    tail = F.when(safe < 1.0, below).otherwise(direct)
    return F.when(lam.isNotNull(), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series after moving the argument up by ten."""
    shifted = x + 10.0
    stirling = (
        (shifted - 0.5) * F.log(shifted)
        - shifted
        + 0.5 * math.log(2.0 * math.pi)
        + 1.0 / (12.0 * shifted)
        - 1.0 / (360.0 * F.pow(shifted, 3))
        + 1.0 / (1260.0 * F.pow(shifted, 5))
        - 1.0 / (1680.0 * F.pow(shifted, 7))
    )
    return F.aggregate(_steps(0, 9), stirling, lambda acc, k: acc - F.log(x + k))


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from its last term upwards.

    Coefficients are those of Abramowitz and Stegun 26.5.8.
    """

    def coefficient(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(
        F.sequence(F.lit(terms), F.lit(1), F.lit(-1)),
        F.lit(1.0),
        lambda acc, k: 1.0 + F.try_divide(coefficient(k), acc),
    )


def _student_beta(t: Column, df: Column) -> Column:
    """Two-sided tail as a regularised incomplete beta function; for moderate ``df``."""
    a, b = df / 2.0, F.lit(0.5)
    x = df / (df + t * t)
    log_front = (
        log_gamma(a + 0.5)
        - log_gamma(a)
        - 0.5 * math.log(math.pi)
        + a * F.log(x)
        + 0.5 * F.log(1.0 - x)
    )
    front = F.exp(log_front)
    small = front / a / _beta_fraction(a, b, x, 200)
    large = 1.0 - front / b / _beta_fraction(b, a, 1.0 - x, 200)
    return F.when(t == 0.0, 1.0).when(x < (a + 1.0) / (a + 2.5), small).otherwise(large)


def _student_large(t: Column, df: Column) -> Column:
    """Hill's (1970) normalising expansion; its error vanishes quickly with ``df``."""
    a = df - 0.5
    b = 48.0 * a * a
    y = a * F.log1p(t * t / df)
    z = (
        (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b)
        + 1.0
    ) * F.sqrt(y)
    return normal_two_sided(z)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t with (possibly fractional) ``df`` degrees of freedom."""
    capped = F.least(df, F.lit(400.0))
    p = F.when(df <= 400.0, _student_beta(t, capped)).otherwise(_student_large(t, df))
    return F.when(t.isNotNull() & df.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
