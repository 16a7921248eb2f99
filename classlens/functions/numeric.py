"""Null-safe numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(column: Column | str) -> Column:
    """The column as double, with NaN turned into NULL."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value), value)


def sample_skewness(column: Column) -> Column:
    """Bias-corrected skewness G1: NULL below three values, 0 for a constant column."""
    n = F.count(column).cast("double")
    corrected = F.skewness(column) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n < 3, F.lit(None)).when(F.min(column) == F.max(column), 0.0).otherwise(corrected)


def hash_digits(key: Column, seed: int, part: int = 0) -> Column:
    """32 hash bits of ``key`` and ``seed`` as a bigint; ``part`` 0..3 picks which of the digest."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint")
