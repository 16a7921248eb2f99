"""Duplicates, sentinels, missing values and median imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.longform import feature_list, long_form, numeric_columns
from classlens.operators.quantile import exact_quantiles


def dedupe(df: DataFrame, key: str | None = None) -> DataFrame:
    """Keep one of each set of exactly equal rows; copies collapse before the shuffle.

    A synthetic ``key`` does not take part in the comparison; the smallest key of the copies is kept.
    """
    if key is None:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != key]
    return df.groupBy(*content).agg(F.min(key).alias(key)).select(*df.columns)


def sentinel_to_null(
    df: DataFrame, sentinel: float = -999, columns: Sequence[str] | None = None
) -> DataFrame:
    """Replace ``sentinel`` by NULL in the given (default: all numeric) columns."""
    chosen = set(numeric_columns(df) if columns is None else columns)
    return df.select(
        *[
            F.when(F.col(c) != sentinel, F.col(c)).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )


def sentinel_counts(
    df: DataFrame, sentinel: float = -999, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(column, n_sentinel)`` for the given (default: all numeric) columns."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    return _per_column(df, chosen, lambda c: F.count_if(F.col(c) == sentinel), "n_sentinel")


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_missing)``: NULL and NaN cells of each column."""
    numeric = set(numeric_columns(df))

    def missing(c):
        value = clean_double(c) if c in numeric else F.col(c)
        return F.count_if(value.isNull())

    return _per_column(df, list(columns or df.columns), missing, "n_missing")


def _per_column(df: DataFrame, columns: list[str], count, name: str) -> DataFrame:
    totals = df.agg(
        F.array(
            *[F.struct(F.lit(c).alias("column"), count(c).alias(name)) for c in columns]
        ).alias("cells")
    )
    return totals.select(F.inline("cells"))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, ordinal, median)`` with the fallback for columns that are entirely missing.

    The fallback is the median of the other medians, or 0 when there is none.
    """
    found = exact_quantiles(long_form(df, columns), [0.5]).select(
        "feature", F.col("quantiles")[0].alias("median")
    )
    fallback = found.agg(F.median("median").alias("median")).scalar()
    return (
        feature_list(df, columns)
        .join(F.broadcast(found), "feature", "left")
        .select("feature", "ordinal", F.coalesce("median", fallback, F.lit(0.0)).alias("median"))
    )


def apply_fill(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Fill NULL and NaN with the fitted medians (one row per column, read to the driver)."""
    values = {r["feature"]: r["median"] for r in medians.collect()}
    return df.select(
        *[
            F.coalesce(clean_double(c), F.lit(values[c])).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def median_impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill the missing cells of numeric columns with the exact column median."""
    chosen = numeric_columns(df) if columns is None else list(columns)
    return apply_fill(df, column_medians(df, chosen))
