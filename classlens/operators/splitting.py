"""Exact stratified train/test split by hashed keys."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classlens.sources.workdir import stage

COARSE_DIGITS = 4
#: Limits of up to so many classes become literals of the projection; beyond, they are joined.
LITERAL_CLASSES = 1_000


def class_quotas(counts: Mapping, test_size: float) -> dict:
    """Test rows per class: ceil(test_size * n) in total, proportional, by largest remainder."""
    if any(n < 2 for n in counts.values()):
        raise ValueError("every class needs at least 2 rows to be split")
    total = sum(counts.values())
    draws = math.ceil(test_size * total)
    quotas = {c: n * draws // total for c, n in counts.items()}
    by_rest = sorted(counts, key=lambda c: (-(counts[c] * draws % total), c))
    for c in by_rest[: draws - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def _quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """``(label, quota)`` as ``class_quotas`` has it, over one row per class."""
    totals = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = stage(totals, "classes")
    if not totals.where("n < 2").isEmpty():
        raise ValueError("every class needs at least 2 rows to be split")
    total = totals.agg(F.sum("n")).first()[0] or 0
    draws = math.ceil(test_size * total)
    shares = totals.select(
        label, F.expr(f"n * {draws} div {max(total, 1)}").alias("q"), F.expr(f"n * {draws} % {max(total, 1)}").alias("rest")
    )
    left = draws - (shares.agg(F.sum("q")).first()[0] or 0)
    place = F.row_number().over(Window.orderBy(F.desc("rest"), label))
    quota = F.col("q") + F.when(F.col("place") <= left, 1).otherwise(0)
    return shares.withColumn("place", place).select(label, quota.alias("quota")).where("quota > 0")


def split_limits(df: DataFrame, key: str, label: str, test_size: float, seed: int) -> DataFrame:
    """``(label, digest, key)`` of the last test row of each class.

    The first hex digits of the digest give equal-sized buckets; only the bucket in which a class reaches
    its quota is ranked.
    """
    wanted = _quotas(df, label, test_size)
    hashed = df.select(
        label, F.col(key).alias("key"), _digest(key, seed).alias("digest")
    ).withColumn("bucket", F.substring("digest", 1, COARSE_DIGITS))
    upto = Window.partitionBy(label).orderBy("bucket")
    reached = (
        hashed.groupBy(label, "bucket")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("upto", F.sum("c").over(upto))
        .join(wanted, label)
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota")))
        .select(label, "bucket", (F.col("quota") - F.col("upto") + F.col("c")).alias("place"))
    )
    # One row per class: staged, so that its size is known and all rows are not shuffled to meet it.
    reached = stage(reached, "reached")
    within = Window.partitionBy(label).orderBy("digest", "key")
    return (
        hashed.join(reached, [label, "bucket"])
        .withColumn("row", F.row_number().over(within))
        .where(F.col("row") == F.col("place"))
        .select(label, "digest", "key")
    )


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` = 'train' or 'test' with exact class quotas.

    In each class the rows with the smallest md5 of key and seed form the test set. The limits are found
    first, so the split itself is a projection (a join beyond ``LITERAL_CLASSES`` classes). The key must be
    unique. A row without a class is an error.
    """
    own = F.struct(_digest(key, seed).alias("digest"), F.col(key).alias("key"))
    kind = df.schema[key].dataType
    found = stage(split_limits(df, key, label, test_size, seed), "limits")
    limits = found.limit(LITERAL_CLASSES + 1).collect()
    no_class = F.raise_error(F.lit(f"'{label}' is null in some rows")).cast("string")
    if len(limits) > LITERAL_CLASSES:
        last = found.select(F.col(label).alias("_label"), F.struct("digest", "key").alias("_last"))
        joined = df.join(last, F.col(label) == F.col("_label"), "left")
        split = F.when(F.col(label).isNull(), no_class).when(own <= F.col("_last"), "test").otherwise("train")
        return joined.select(*df.columns, split.alias("split"))
    is_test = F.lit(False)
    for limit in limits:
        last = F.struct(
            F.lit(limit["digest"]).alias("digest"), F.lit(limit["key"]).cast(kind).alias("key")
        )
        is_test = is_test | ((F.col(label) == limit[label]) & (own <= last))
    return df.withColumn("split", F.when(F.col(label).isNull(), no_class).when(is_test, "test").otherwise("train"))
