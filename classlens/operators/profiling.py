"""Per-feature profiles, scale recommendations and table summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double, sample_skewness
from classlens.operators.longform import feature_list, long_form, melt

# Limits of the scale recommendation.
ONE_SIGN_RANGE = 1000
ONE_SIGN_SKEW = 3
MIXED_SYMLOG_RANGE = 1e6
MIXED_ASINH_RANGE = 1e4


def _recommended_scale() -> Column:
    """Scale by sign of the data: one-signed data by range or skew, mixed data by dynamic range."""
    negatives, positives = F.col("n_negative") > 0, F.col("n_positive") > 0
    skewed = F.abs(F.col("skewness")) > ONE_SIGN_SKEW
    wide_positive = F.col("max_positive") / F.col("min_positive") > ONE_SIGN_RANGE
    wide_negative = F.abs(F.col("min_negative") / F.col("max_negative")) > ONE_SIGN_RANGE
    several_positive, several_negative = F.col("n_positive") > 1, F.col("n_negative") > 1
    return (
        F.when(F.col("n") < 2, "linear")
        .when(positives & ~negatives & several_positive & (wide_positive | skewed), "log")
        .when(negatives & positives & (F.col("dynamic_range") > MIXED_SYMLOG_RANGE), "symlog")
        .when(negatives & positives & (F.col("dynamic_range") > MIXED_ASINH_RANGE), "asinh")
        .when(negatives & ~positives & several_negative & (wide_negative | skewed), "symlog")
        .otherwise("linear")
    )


def profile_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature that has values: range, skewness, signs and the recommended scale."""
    value = F.col("value")
    positive, negative = F.when(value > 0, value), F.when(value < 0, value)
    magnitude = F.when(value != 0, F.abs(value))
    sums = (
        long_form(df, features)
        .groupBy("feature")
        .agg(
            F.count(value).alias("n"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            sample_skewness(value).alias("skewness"),
            F.count(positive).alias("n_positive"),
            F.count(negative).alias("n_negative"),
            F.min(positive).alias("min_positive"),
            F.max(positive).alias("max_positive"),
            F.min(negative).alias("min_negative"),
            F.max(negative).alias("max_negative"),
            F.min(magnitude).alias("min_magnitude"),
        )
    )
    largest = F.greatest(F.abs("min"), F.abs("max"))
    shaped = sums.withColumn(
        "dynamic_range", F.coalesce(F.try_divide(largest, F.col("min_magnitude")), F.lit(1.0))
    ).withColumn("recommended_scale", _recommended_scale())
    return feature_list(df, features).join(F.broadcast(shaped), "feature").select(
        "feature",
        "ordinal",
        "recommended_scale",
        "n",
        "min",
        "max",
        "dynamic_range",
        "skewness",
        (F.col("n_negative") > 0).alias("has_negatives"),
        (F.col("n_positive") > 0).alias("has_positives"),
        ((F.col("min") <= 0) & (F.col("max") >= 0)).alias("span_zero"),
    )


def scaling_summary(profile: DataFrame) -> DataFrame:
    """Features per recommended scale, with the first three in column order as examples."""
    example = F.struct("ordinal", "feature", "min", "max")
    return profile.groupBy("recommended_scale").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.slice(F.array_sort(F.collect_list(example)), 1, 3).alias("examples"),
    )


def basic_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, n, mean, std)``: rows including nulls, mean and sample standard deviation."""
    wide = df.select(*[clean_double(f).alias(f) for f in features])
    return (
        melt(wide, [], features)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
        )
    )


def data_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: sample and class counts, share of class 1, feature count, missing cells."""
    columns = df.columns
    numeric = {f for f, t in df.dtypes if t in ("double", "float")}
    missing = [
        (clean_double(c) if c in numeric else F.col(c)).isNull().cast("bigint") for c in columns
    ]
    total = missing[0]
    for m in missing[1:]:
        total = total + m
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col(target) == 1).alias("signal_count"),
        F.count_if(F.col(target) == 0).alias("background_count"),
        F.try_divide(F.count_if(F.col(target) == 1), F.count(F.lit(1))).alias("signal_ratio"),
        F.lit(len(columns) - 1).alias("feature_count"),
        F.sum(total).alias("missing_values"),
    )


def class_count_check(
    df: DataFrame, target: str, expected_signal: int, expected_background: int
) -> DataFrame:
    """``(label, n, expected, matches)`` for both classes; a mismatch is reported, not raised."""
    counts = df.agg(
        F.count_if(F.col(target) == 1).alias("s"), F.count_if(F.col(target) == 0).alias("b")
    )
    cells = [
        F.struct(
            F.lit(label).alias("label"),
            F.col(column).alias("n"),
            F.lit(expected).cast("bigint").alias("expected"),
            (F.col(column) == expected).alias("matches"),
        )
        for label, column, expected in ((1, "s", expected_signal), (0, "b", expected_background))
    ]
    return counts.select(F.inline(F.array(*cells)))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Row count of each target value, largest first."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), target)


def split_shapes(splits: DataFrame, n_features: int) -> DataFrame:
    """``(split, n_rows, n_features)``."""
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(n_features).alias("n_features")
    )
