"""Ranked value table: distinct values per feature with exact running counts.

``value_counts`` collapses ties on the map side, so one value that holds a third of all rows becomes
one row. The running counts are not taken over a whole feature in one task: values are first cut into
buckets at approximate quantiles, each bucket is scanned by its own task, and the counts before a bucket
come from the (small) table of bucket totals. Where the cuts lie affects the balance only, never the
result; they are taken to the driver once so that every evaluation of the plan sees the same cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.longform import long_form

MAX_BUCKETS = 1024


def bucket_count(df: DataFrame) -> int:
    """A power of two that follows the number of shuffle partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, 1 << max(0, (partitions - 1).bit_length()))


def cut_columns(features: Sequence[str], buckets: int) -> list[Column]:
    """Aggregates, one per feature and named like it, that give ``buckets - 1`` ascending cuts."""
    probs = [i / buckets for i in range(1, buckets)]
    size = max(200, 4 * buckets)

    def quantiles(feature: str) -> Column:
        if not probs:
            return F.max(F.lit(None).cast("array<double>")).alias(feature)
        sketch = F.kll_sketch_agg_double(clean_double(feature), F.lit(size))
        found = F.kll_sketch_get_quantile_double(sketch, F.lit(probs))
        return F.when(F.count(clean_double(feature)) > 0, found).alias(feature)

    return [quantiles(f) for f in features]


def cuts_table(spark: SparkSession, features: Sequence[str], row: Row, buckets: int) -> DataFrame:
    """Table ``(feature, cuts)`` from the row of ``cut_columns``: one row per feature."""
    rows = [(f, row[f] or [0.0] * (buckets - 1)) for f in features]
    return spark.createDataFrame(rows, "feature string, cuts array<double>")


def bucket_cuts(df: DataFrame, features: Sequence[str], buckets: int) -> DataFrame:
    """Table ``(feature, cuts)`` with ``buckets - 1`` ascending cuts: one row per feature.

    One pass of mergeable sketches; the driver sees ``buckets - 1`` numbers per feature.
    """
    return cuts_table(df.sparkSession, features, df.agg(*cut_columns(features, buckets)).first(), buckets)


def with_bucket(counts: DataFrame, cuts: DataFrame, buckets: int) -> DataFrame:
    """Add ``bucket`` = number of cuts below the value, by unrolled binary search."""
    out = counts.join(F.broadcast(cuts), "feature").withColumn("bucket", F.lit(0))
    step = buckets // 2
    while step:
        passed = F.get(F.col("cuts"), F.col("bucket") + (step - 1)) < F.col("value")
        out = out.withColumn("bucket", F.col("bucket") + F.when(passed, step).otherwise(0))
        step //= 2
    return out.drop("cuts")


def running_counts(
    counts: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    measures: Sequence[str],
    order: str = "value",
) -> DataFrame:
    """Add ``before_<m>`` (sum over smaller values) and ``total_<m>`` per key.

    ``bucket`` must be monotone in ``order``; a bucket is the unit of work of one task.
    """
    keys, bucket = list(keys), list(bucket)
    upto = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    inside = (
        Window.partitionBy(*keys, *bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        counts.groupBy(*keys, *bucket)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            *bucket,
            *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(f"base_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
        )
    )
    local = counts.select(
        *counts.columns,
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"local_{m}") for m in measures],
    )
    return local.join(offsets, [*keys, *bucket]).select(
        *counts.columns,
        *[(F.col(f"base_{m}") + F.col(f"local_{m}")).alias(f"before_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )


def value_counts(long: DataFrame) -> DataFrame:
    """``(feature, value, n0, n1)``: how often each distinct value occurs in each class."""
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )


def ranked_values(
    df: DataFrame, features: Sequence[str], label: str, buckets: int | None = None, cuts: DataFrame | None = None
) -> DataFrame:
    """Ranked value table of all features: class counts, counts before each value, class totals."""
    buckets = buckets or bucket_count(df)
    counts = value_counts(long_form(df, features, label))
    bucketed = with_bucket(counts, bucket_cuts(df, features, buckets) if cuts is None else cuts, buckets)
    return running_counts(bucketed, ["feature"], ["bucket"], ["n0", "n1"]).drop("bucket")


def rank_statistics(ranked: DataFrame) -> DataFrame:
    """Per feature: class sizes, AUC, rank-sum U, tie term, KS distance.

    Products of counts are taken in double because they exceed a bigint on large tables.
    """
    return with_auc(ranked.groupBy("feature").agg(*rank_sums()))


#: How the columns of ``rank_sums`` of parts of a feature are put together.
MERGED = {"n_background": F.max, "n_signal": F.max, "n_distinct": F.sum, "u_signal": F.sum, "tie_term": F.sum, "tied_pairs": F.sum, "ks_d": F.max}


def rank_sums() -> list[Column]:
    """Aggregates over ranked values; they can be taken over parts of a feature and merged."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    t = n0 + n1
    total0, total1 = F.col("total_n0"), F.col("total_n1")
    below = F.col("before_n0").cast("double")
    step0 = F.try_divide(F.col("before_n0") + F.col("n0"), total0)
    step1 = F.try_divide(F.col("before_n1") + F.col("n1"), total1)
    return [
        F.max(total0).alias("n_background"),
        F.max(total1).alias("n_signal"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum(n1 * (below + n0 / 2.0)).alias("u_signal"),
        F.sum(t * t * t - t).alias("tie_term"),
        F.sum(t * (t - 1.0) / 2.0).alias("tied_pairs"),
        F.max(F.abs(step0 - step1)).alias("ks_d"),
    ]


def with_auc(sums: DataFrame) -> DataFrame:
    pairs = F.col("n_background").cast("double") * F.col("n_signal").cast("double")
    return sums.withColumn("auc", F.try_divide(F.col("u_signal"), pairs))
