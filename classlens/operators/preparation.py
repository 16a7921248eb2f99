"""Variance filter, scaling and outlier flag: ``fit`` gives a parameter table, ``apply`` is map-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.longform import feature_list, long_form
from classlens.operators.quantile import exact_quantiles
from classlens.params import SCALE_METHODS


def prepare_features(df: DataFrame, target: str, key: str | None = None) -> DataFrame:
    """``(key, target as int, features as double)`` in one frame; rows stay aligned by construction."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    label = F.col(target)
    if dict(df.dtypes)[target] in ("double", "float"):
        label = clean_double(target)
    features = [c for c in df.columns if c not in (target, key)]
    return df.select(
        *([key] if key else []),
        label.cast("int").alias(target),
        *[clean_double(c).alias(c) for c in features],
    )


def fit(
    df: DataFrame,
    features: Sequence[str],
    method: str = "standard",
    variance_threshold: float = 1e-6,
) -> DataFrame:
    """Parameter table ``(feature, ordinal, variance, mean, std, center, scale, kept)``.

    A feature is kept when its population variance exceeds the threshold; at threshold 0 the smaller of
    variance and range must be positive. A zero scale becomes 1.
    """
    if method not in SCALE_METHODS:
        raise ValueError(f"scale method must be one of {SCALE_METHODS}")
    long = long_form(df, features)
    moments = long.groupBy("feature").agg(
        F.var_pop("value").alias("variance"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        (F.max("value") - F.min("value")).alias("range"),
    )
    if method == "robust":
        quartiles = exact_quantiles(long, [0.25, 0.5, 0.75]).select(
            "feature",
            F.col("quantiles")[1].alias("center"),
            (F.col("quantiles")[2] - F.col("quantiles")[0]).alias("scale"),
        )
        located = moments.join(F.broadcast(quartiles), "feature")
    else:
        located = moments.withColumn("center", F.col("mean")).withColumn("scale", F.col("std"))
    spread = F.col("variance")
    if variance_threshold == 0:
        spread = F.least("variance", "range")
    constant = F.col("range") == 0
    return (
        feature_list(df, features)
        .join(F.broadcast(located), "feature", "left")
        .select(
            "feature",
            "ordinal",
            F.when(constant, 0.0).otherwise(F.col("variance")).alias("variance"),
            "mean",
            F.when(constant, 0.0).otherwise(F.col("std")).alias("std"),
            "center",
            F.when(constant | (F.col("scale") == 0), 1.0).otherwise(F.col("scale")).alias("scale"),
            F.coalesce(~constant & (spread > variance_threshold), F.lit(False)).alias("kept"),
        )
    )


def fitted_rows(params: DataFrame) -> list:
    """Kept rows of a parameter table in column order: at most one row per feature."""
    rows = sorted((r for r in params.collect() if r["kept"]), key=lambda r: r["ordinal"])
    if not rows:
        raise ValueError("no feature exceeds the variance threshold")
    return rows


def apply(
    df: DataFrame,
    params: DataFrame,
    keep: Sequence[str] = (),
    outlier_threshold: float | None = None,
) -> DataFrame:
    """Scale the kept features of ``df`` with fitted parameters; nothing is refitted.

    It is one projection, so it works on batch and streaming frames alike. With ``outlier_threshold`` the
    column ``is_outlier`` is 1 where any kept feature is further than that many standard deviations off.
    """
    rows = fitted_rows(params)
    missing = [r["feature"] for r in rows if r["feature"] not in df.columns]
    if missing:
        raise ValueError(f"missing fitted features: {missing}")
    columns = [F.col(c) for c in keep]
    for r in rows:
        scaled = (clean_double(r["feature"]) - r["center"]) / r["scale"]
        columns.append(scaled.alias(r["feature"]))
    if outlier_threshold is not None:
        columns.append(outlier_flag(rows, outlier_threshold).alias("is_outlier"))
    return df.select(*columns)


def outlier_flag(rows: list, threshold: float = 4.0):
    """1 when any |z| exceeds the threshold; constant and missing values never do."""
    flag = F.lit(False)
    for r in rows:
        if r["std"]:
            z = F.abs((clean_double(r["feature"]) - r["mean"]) / r["std"])
            flag = flag | F.coalesce(z > threshold, F.lit(False))
    return flag.cast("int")


def as_vector(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Matrix form: the features of a row as one ``array<double>`` column."""
    return df.select(*keep, F.array(*features).alias("features"))
