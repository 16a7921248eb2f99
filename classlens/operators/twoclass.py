"""Two-class statistics for all features in one job.

Class 0 is the background and class 1 the signal. Nulls are dropped per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.functions.tails import kolmogorov_tail, normal_two_sided, student_two_sided
from classlens.operators.exact_tests import exact_ks, exact_mannwhitney
from classlens.operators.longform import every_feature, feature_list, long_form
from classlens.operators.ranked import rank_statistics, ranked_values

METHODS = ("mannwhitney", "ks", "ttest")


def class_moments(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature: size, mean and sample variance of each class (``n0, mean0, var0, n1, ...``)."""
    background = F.when(F.col("label") == 0, F.col("value"))
    signal = F.when(F.col("label") == 1, F.col("value"))
    return (
        long_form(df, features, label)
        .groupBy("feature")
        .agg(
            F.count(background).alias("n0"),
            F.avg(background).alias("mean0"),
            F.var_samp(background).alias("var0"),
            F.count(signal).alias("n1"),
            F.avg(signal).alias("mean1"),
            F.var_samp(signal).alias("var1"),
        )
    )


def cohen_d_expression() -> Column:
    """Mean difference over the root of the unweighted mean of both variances."""
    pooled = F.sqrt((F.col("var0") + F.col("var1")) / 2.0)
    return F.when(pooled > 0, F.try_divide(F.col("mean0") - F.col("mean1"), pooled))


def effect_size(
    df: DataFrame, features: Sequence[str], label: str, method: str = "cohen_d"
) -> DataFrame:
    """``(feature, effect_size)`` by Cohen's d or Cliff's delta."""
    if method == "cohen_d":
        moments = class_moments(df, features, label)
        found = moments.select("feature", cohen_d_expression().alias("effect_size"))
        return every_feature(df, features, found)
    if method == "cliffs_delta":
        stats = rank_statistics(ranked_values(df, features, label))
        found = stats.select("feature", (1.0 - 2.0 * F.col("auc")).alias("effect_size"))
        return every_feature(df, features, found)
    raise ValueError(f"unknown method: {method}")


def with_mannwhitney(stats: DataFrame) -> DataFrame:
    """Add U of the background, z and the two-sided p (tie and continuity corrected)."""
    n0, n1 = F.col("n_background").cast("double"), F.col("n_signal").cast("double")
    n = n0 + n1
    u0 = n0 * n1 - F.col("u_signal")
    spread = F.sqrt(n0 * n1 / 12.0 * ((n + 1.0) - F.try_divide(F.col("tie_term"), n * (n - 1.0))))
    larger = F.greatest(u0, F.col("u_signal"))
    z = F.try_divide(larger - n0 * n1 / 2.0 - 0.5, spread)
    p = F.when(z < 0, 1.0).otherwise(normal_two_sided(z))
    usable = (n0 > 0) & (n1 > 0)
    return (
        stats.withColumn("u_background", F.when(usable, u0))
        .withColumn("z", F.when(usable, z))
        .withColumn("p_mannwhitney", F.when(usable & z.isNotNull(), p))
    )


def with_ks(stats: DataFrame) -> DataFrame:
    """Add the asymptotic two-sided p of the two-sample Kolmogorov-Smirnov test."""
    n0, n1 = F.col("n_background").cast("double"), F.col("n_signal").cast("double")
    lam = F.sqrt(F.try_divide(n0 * n1, n0 + n1)) * F.col("ks_d")
    return stats.withColumn("p_ks", kolmogorov_tail(lam))


def with_ttest(moments: DataFrame, equal_var: bool = False) -> DataFrame:
    """Add t, its degrees of freedom and the two-sided p; Welch's form unless ``equal_var``."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    if equal_var:
        freedom = n0 + n1 - 2.0
        weighted = (n0 - 1.0) * F.col("var0") + (n1 - 1.0) * F.col("var1")
        variance = F.try_divide(weighted, freedom) * (
            F.try_divide(F.lit(1.0), n0) + F.try_divide(F.lit(1.0), n1)
        )
    else:
        part0, part1 = F.try_divide(F.col("var0"), n0), F.try_divide(F.col("var1"), n1)
        variance = part0 + part1
        freedom = F.try_divide(
            variance * variance,
            F.try_divide(part0 * part0, n0 - 1.0) + F.try_divide(part1 * part1, n1 - 1.0),
        )
    t = F.try_divide(F.col("mean0") - F.col("mean1"), F.sqrt(variance))
    return (
        moments.withColumn("t", t)
        .withColumn("df", freedom)
        .withColumn("p_ttest", student_two_sided(F.col("t"), F.col("df")))
    )


def feature_tests(df: DataFrame, features: Sequence[str], label: str, method: str, exact: bool = False) -> DataFrame:
    """``(feature, p_value)`` of one test for every feature with at least one value; ``exact`` as in ``feature_separation``."""
    if method == "ttest":
        tested = with_ttest(class_moments(df, features, label))
        return tested.select("feature", F.col("p_ttest").alias("p_value"))
    stats = rank_statistics(ranked_values(df, features, label))
    if method == "mannwhitney":
        tested = exact_mannwhitney(with_mannwhitney(stats)) if exact else with_mannwhitney(stats)
        return tested.select("feature", F.col("p_mannwhitney").alias("p_value"))
    if method == "ks":
        tested = exact_ks(with_ks(stats)) if exact else with_ks(stats)
        return tested.select("feature", F.col("p_ks").alias("p_value"))
    raise ValueError(f"unknown method: {method}")


def feature_separation(
    df: DataFrame, features: Sequence[str], label: str, method: str = "mannwhitney", exact: bool = False
) -> DataFrame:
    """``(feature, p_value, method)``, one row per requested feature.

    A feature without values, and every feature under an unknown method, gets a NULL p-value. ``exact`` takes exact
    p-values for small classes: Mann-Whitney with at most 8 values in one class and no ties, KS with at most 10,000 in each.
    """
    names = feature_list(df, features)
    if method not in METHODS:
        tested = names.select("feature", F.lit(None).cast("double").alias("p_value"))
    else:
        tests = feature_tests(df, features, label, method, exact)
        tested = names.join(F.broadcast(tests), "feature", "left")
    return tested.select("feature", "p_value", F.lit(method).alias("method"))


def feature_auc(
    df: DataFrame, features: Sequence[str], label: str, strict_nulls: bool = False
) -> DataFrame:
    """``(feature, auc, n_null)``; with ``strict_nulls`` a feature that has nulls gets NULL.

    All are NULL unless the label has exactly two values.
    """
    stats = rank_statistics(ranked_values(df, features, label))
    two_class = df.where(F.col(label).isin(0, 1))
    n_rows = two_class.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    filled = F.coalesce(F.col("n_background") + F.col("n_signal"), F.lit(0))
    joined = (
        feature_list(df, features)
        .join(F.broadcast(stats), "feature", "left")
        .withColumn("n_null", n_rows - filled)
    )
    classes = df.agg(F.count_distinct(F.col(label)).alias("classes")).scalar()
    auc = F.when(classes == 2, F.col("auc"))
    auc = F.when(F.col("n_null") == 0, auc) if strict_nulls else auc
    return joined.select("feature", auc.alias("auc"), "n_null")
