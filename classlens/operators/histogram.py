"""Equal-width histograms, Jensen-Shannon divergence and per-class locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.operators.longform import every_feature, long_form
from classlens.operators.quantile import exact_quantiles

BINNINGS = ("own", "shared")
FLOOR_DENSITY = 1e-12


def _ranges(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, lo, hi)``; a range of width zero is widened by a half on both sides."""
    sums = long.groupBy(*keys).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    flat = F.col("a") == F.col("b")
    return sums.select(
        *keys,
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
    )


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin; the last bin includes its upper edge."""
    place = F.floor((value - lo) / (hi - lo) * bins)
    return F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")


def bin_counts(
    long: DataFrame, bins: int, keys: Sequence[str] = ("feature", "label"), shared: bool = False
) -> DataFrame:
    """``(keys, lo, hi, n, counts)`` with ``counts`` an array of length ``bins``.

    The range is that of the key's own values, or of the whole feature when ``shared``. Only bin counts
    are shuffled.
    """
    keys = list(keys)
    range_keys = ["feature"] if shared else keys
    binned = long.join(F.broadcast(_ranges(long, range_keys)), range_keys).withColumn(
        "bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins)
    )
    filled = binned.groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"))
    cells = filled.groupBy(*keys, "lo", "hi").agg(
        F.sum("c").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("by_bin"),
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.coalesce(F.element_at("by_bin", b), F.lit(0).cast("bigint")),
    )
    return cells.select(*keys, "lo", "hi", "n", dense.alias("counts"))


def class_histogram(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 50, binning: str = "own"
) -> DataFrame:
    """``(feature, label, bin, lo, hi, n, density)`` for every bin of every class."""
    if binning not in BINNINGS:
        raise ValueError(f"binning must be one of {BINNINGS}")
    counts = bin_counts(long_form(df, features, label), bins, shared=binning == "shared")
    return _bins(counts, ["feature", "label"], bins)


def distribution_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``(feature, bin, lo, hi, n, density)`` of one column, all classes together."""
    return _bins(bin_counts(long_form(df, [column]), bins, ["feature"]), ["feature"], bins)


def _bins(counts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    width = (F.col("lo_all") - F.col("hi_all")) / F.lit(-float(bins))
    rows = counts.withColumnsRenamed({"lo": "lo_all", "hi": "hi_all", "n": "total"}).select(
        *keys, "lo_all", "hi_all", "total", F.posexplode("counts").alias("bin", "n")
    )
    return rows.select(
        *keys,
        "bin",
        (F.col("lo_all") + width * F.col("bin")).alias("lo"),
        (F.col("lo_all") + width * (F.col("bin") + 1)).alias("hi"),
        "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )


def js_divergence(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 50, binning: str = "own"
) -> DataFrame:
    """``(feature, js_divergence)`` in nats between the class histograms.

    With ``binning="own"`` each class is cut over its own range, so a pure shift is not seen; ``"shared"``
    cuts both over the common range and is bounded by ln 2. NULL when a class is empty.
    """
    if binning not in BINNINGS:
        raise ValueError(f"binning must be one of {BINNINGS}")
    counts = bin_counts(long_form(df, features, label), bins, shared=binning == "shared")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    density = F.transform(
        "counts", lambda c: F.greatest(c / (F.col("n") * width), F.lit(FLOOR_DENSITY))
    )
    both = (
        counts.select("feature", "label", density.alias("d"))
        .groupBy("feature")
        .agg(
            F.max(F.when(F.col("label") == 0, F.col("d"))).alias("p"),
            F.max(F.when(F.col("label") == 1, F.col("d"))).alias("q"),
        )
    )
    return every_feature(df, features, with_divergence(both).select("feature", "js_divergence"))


def with_divergence(densities: DataFrame) -> DataFrame:
    """Add ``js_divergence`` of the density arrays ``p`` and ``q``; NULL if one is NULL."""
    both = densities.withColumn("m", F.zip_with("p", "q", lambda a, b: (a + b) / 2.0))

    def total(column: str) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda acc, v: acc + v)

    def entropy(column: str) -> Column:
        terms = F.zip_with(
            column, "m", lambda a, b: a / F.col("s") * F.log((a / F.col("s")) / (b / F.col("sm")))
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    summed = both.withColumn("sm", total("m"))
    with_p = summed.withColumn("s", total("p")).withColumn("ep", entropy("p"))
    with_q = with_p.withColumn("s", total("q")).withColumn("eq", entropy("q"))
    return with_q.withColumn("js_divergence", (F.col("ep") + F.col("eq")) / 2.0)


def trim_percentiles(
    df: DataFrame, features: Sequence[str], label: str, limits: tuple[float, float] = (1, 99)
) -> DataFrame:
    """``(feature, lower, upper)``: exact percentiles of both classes together."""
    found = exact_quantiles(long_form(df, features, label), [p / 100.0 for p in limits])
    found = found.select(
        "feature",
        F.col("quantiles")[0].alias("lower"),
        F.col("quantiles")[1].alias("upper"),
    )
    return every_feature(df, features, found)


def class_location(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, label, mean, median)``."""
    long = long_form(df, features, label)
    keys = ["feature", "label"]
    medians = exact_quantiles(long, [0.5], keys).select(
        *keys, F.col("quantiles")[0].alias("median")
    )
    means = long.groupBy(*keys).agg(F.avg("value").alias("mean"))
    return means.join(F.broadcast(medians), keys).select(*keys, "mean", "median")


def significance_stars(p: Column) -> Column:
    """``***`` below .001, ``**`` below .01, ``*`` below .05, else ``ns``."""
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )
