"""Wide feature table to long form ``(feature, value)``, and schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from classlens.functions.numeric import clean_double


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in exclude
    ]


def validate_frame(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Raise when ``df`` is not a DataFrame, lacks a required column or has no row."""
    if not isinstance(df, DataFrame):
        raise TypeError("input must be a Spark DataFrame")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if df.isEmpty():
        raise ValueError("input DataFrame is empty")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Redistribute the rows of a table that is scanned by fewer tasks than a shuffle has.

    Meant for narrow rows ahead of work that multiplies them; a table of many splits is left as it is.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(*ids, feature, value)`` with one row per feature column, nulls included.

    An array is inlined rather than calling ``unpivot``: two copies of the result in one plan then compare
    as equal, so an aggregate that is read twice is computed and shuffled once.
    """
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]
    return df.select(*ids, F.inline(F.array(*cells)))


def long_form(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per non-null ``(row, feature)``; with ``label``, only rows of class 0 and 1 remain."""
    ids = list(keep)
    columns = [F.col(k) for k in keep]
    if label is not None:
        df = df.where(F.col(label).isin(0, 1))
        columns.append(F.col(label).cast("int").alias("label"))
        ids.append("label")
    wide = df.select(*columns, *[clean_double(f).alias(f) for f in features])
    return melt(wide, ids, features).where(F.col("value").isNotNull())


def feature_list(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature names as a table ``(feature, ordinal)``: one row per column of the schema."""
    return df.sparkSession.createDataFrame(
        [(name, i) for i, name in enumerate(features)], "feature string, ordinal int"
    )


def every_feature(df: DataFrame, features: Sequence[str], found: DataFrame) -> DataFrame:
    """``found`` with a row for every feature, NULL where it has none; one row per feature on either side."""
    return feature_list(df, features).select("feature").join(F.broadcast(found), "feature", "left").select(*found.columns)
