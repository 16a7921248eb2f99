"""Exact interpolated quantiles without a full sort.

A sketch brackets each wanted rank; rows outside the brackets are only counted (they collapse on the map
side), rows inside keep their value. The counts inside the brackets are then ranked in sub-buckets. The
result is exact for any valid bracket: the sketch decides how few rows are shuffled, not what is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classlens.operators.ranked import running_counts

ACCURACY = 10_000
EXACT_BELOW = 2 * ACCURACY
SUB_BUCKETS = 256


def _sketched(source: DataFrame, keys: Sequence[str], marks: Sequence[float], accuracy: int) -> DataFrame:
    return source.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", F.lit(marks), accuracy).alias("marks"),
    )


def _bracketed(
    source: DataFrame, keys: list[str], ranks: list[float], margin: float, exact_below: int | None, accuracy: int
) -> DataFrame:
    """``(*keys, n, a0, b0, a1, b1, ...)``: the order statistics on both sides of each rank; NULL where a bracket missed.

    Without ``exact_below`` every value is kept.
    """
    marks = [min(max(p + s * margin, 0.0), 1.0) for p in ranks for s in (-1, 1)]
    sketch = _sketched(source, keys, marks, accuracy)
    everything = F.lit(True) if exact_below is None else F.col("n") <= exact_below

    band, low, high = F.lit(2 * len(ranks)), F.lit(None).cast("double"), F.lit(None).cast("double")
    for i in reversed(range(len(ranks))):
        lo, hi = F.col("marks")[2 * i], F.col("marks")[2 * i + 1]
        inside, below = F.col("value") <= hi, F.col("value") < lo
        band = F.when(below, 2 * i).when(inside, 2 * i + 1).otherwise(band)
        low = F.when(below, F.lit(None)).when(inside, lo).otherwise(low)
        high = F.when(below, F.lit(None)).when(inside, hi).otherwise(high)
    if exact_below is None:  # spread over the whole range, so that no task sorts all values
        low, high = F.col("marks")[0], F.col("marks")[2 * len(ranks) - 1]
    place = F.floor(F.try_divide(F.col("value") - low, high - low) * SUB_BUCKETS)
    sub = F.greatest(F.coalesce(F.least(place, F.lit(SUB_BUCKETS - 1)), F.lit(0)), F.lit(0))
    banded = source.join(F.broadcast(sketch), keys).select(
        *keys,
        F.when(everything, 1).otherwise(band).alias("band"),
        (sub if exact_below is None else F.when(everything, 0).otherwise(sub)).alias("sub"),
        F.when(everything | (band % 2 == 1), F.col("value")).alias("value"),
    )
    counts = banded.groupBy(*keys, "band", "sub", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_counts(counts, keys, ["band", "sub"], ["c"])

    def at(rank):
        covers = (F.col("before_c") <= rank) & (rank < F.col("before_c") + F.col("c"))
        return F.max(F.when(covers, F.col("value")))

    picked = []
    for i, p in enumerate(ranks):
        position = (F.col("total_c") - 1).cast("double") * p
        picked += [at(F.floor(position)).alias(f"a{i}"), at(F.ceil(position)).alias(f"b{i}")]
    return ranked.groupBy(*keys).agg(F.max("total_c").alias("n"), *picked)


def exact_quantiles(
    long: DataFrame,
    probs: Sequence[float],
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    exact_below: int = EXACT_BELOW,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``(*keys, n, quantiles)`` with ``quantiles`` an array in the order of ``probs``.

    Linear interpolation between order statistics, nulls ignored; there is one result row per key, so the
    number of keys must be small (features, or features by class): those rows pass through the driver. Keys with at
    most ``exact_below`` values keep all of their values; from there on a bracket of twice the sketch's error on each
    side holds the wanted rank and its neighbour. If one does not, brackets are widened eightfold and the values counted
    again, in the end with all values inside, so that the result is exact whatever the sketch returns.
    """
    keys, probs = list(keys), list(probs)
    ranks = sorted(set(probs))
    source = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    margin = 2.0 / accuracy
    while True:
        found = _bracketed(source, keys, ranks, margin, exact_below if margin < 1.0 else None, accuracy)
        rows = found.collect()
        if all(r[f"{side}{i}"] is not None for r in rows for i in range(len(ranks)) for side in "ab"):
            break
        if margin >= 1.0:
            raise AssertionError("a rank is missing among all values")
        margin *= 8.0
    found = long.sparkSession.createDataFrame(rows, found.schema)

    def interpolate(i: int):
        position = (F.col("n") - 1).cast("double") * ranks[i]
        share = position - F.floor(position)
        return F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(
            F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * share
        )

    result = F.array(*[interpolate(ranks.index(p)) for p in probs])
    return found.select(*keys, "n", result.alias("quantiles"))


def values_at_ranks(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Look up ``targets(feature, rank, ...)`` (0-based ranks) in a table with ``before`` and ``value``.

    ``before`` is the number of rows below ``value``. Only the stretch of the table between the smallest
    and the largest wanted rank is kept before the look-up; the targets are a bounded parameter table.
    """
    extra = [c for c in targets.columns if c not in ("feature", "rank")]
    span = targets.groupBy("feature").agg(
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")
    )
    last_before = ranked.join(F.broadcast(span), "feature").where(
        (F.col("before") <= F.col("last_rank")) & (F.col("after") > F.col("first_rank"))
    )
    stretch = last_before.select(
        "feature", F.col("before").alias("rank"), "value", F.lit(0).alias("is_target")
    )
    asked = targets.withColumn("value", F.lit(None).cast("double")).withColumn(
        "is_target", F.lit(1)
    )
    order = Window.partitionBy("feature").orderBy("rank", "is_target")
    return (
        stretch.unionByName(asked, allowMissingColumns=True)
        .withColumn("found", F.last("value", ignorenulls=True).over(order))
        .where(F.col("is_target") == 1)
        .select("feature", "rank", *extra, F.col("found").alias("value"))
    )
