"""Class separation of all features: the flagship table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.operators.exact_tests import exact_ks, exact_mannwhitney
from classlens.operators.histogram import BINNINGS, FLOOR_DENSITY, bin_index, significance_stars, with_divergence
from classlens.operators.longform import feature_list, long_form, validate_frame
from classlens.operators.ranked import MERGED, bucket_count, rank_sums, ranked_values, with_auc
from classlens.operators.twoclass import METHODS, cohen_d_expression, with_ks, with_mannwhitney, with_ttest


def class_profile(df: DataFrame, features: Sequence[str], label: str, buckets: int) -> DataFrame:
    """``(feature, cuts, n0, mean0, var0, a0, b0, n1, ...)``: moments and range of each class, and bucket cuts.

    One pass and one mergeable aggregate by feature and class. A row per feature passes through the driver, so that
    everything after it sees the same cuts.
    """
    probs = [i / buckets for i in range(1, buckets)]
    own = long_form(df, features, label).groupBy("feature", "label").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"),
        F.min("value").alias("a"),
        F.max("value").alias("b"),
        F.kll_sketch_agg_double("value", F.lit(max(200, 4 * buckets))).alias("sketch"),
    )

    def of(c: int) -> list[Column]:
        return [F.max(F.when(F.col("label") == c, F.col(x))).alias(f"{x}{c}") for x in ("n", "mean", "var", "a", "b")]

    found = own.groupBy("feature").agg(
        (F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("sketch"), F.lit(probs)) if probs else F.array().cast("array<double>")).alias("cuts"),
        *of(0),
        *of(1),
    )
    found = found.withColumns({f"n{c}": F.coalesce(f"n{c}", F.lit(0).cast("bigint")) for c in (0, 1)})
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def _ranges(profile: DataFrame, shared: bool) -> DataFrame:
    """``(feature, lo0, hi0, lo1, hi1)``: what each class is cut over; a range of width zero is widened by a half on both sides."""
    low = lambda c: F.least("a0", "a1") if shared else F.col(f"a{c}")
    high = lambda c: F.greatest("b0", "b1") if shared else F.col(f"b{c}")
    columns = []
    for c in (0, 1):
        flat = F.when(low(c) == high(c), 0.5).otherwise(0.0)
        columns += [(low(c) - flat).alias(f"lo{c}"), (high(c) + flat).alias(f"hi{c}")]
    return profile.select("feature", *columns)


def separation_summary(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    method: str = "mannwhitney",
    bins: int = 50,
    binning: str = "own",
    exact: bool = False,
) -> DataFrame:
    """``(feature, auc, effect_size, p_value, stars, js_divergence)``; constant features are left out.

    The table is read twice. The first pass gives each class's moments and range and the bucket cuts; the second counts
    the values. The ranked values are reduced by histogram cell: the cells of both classes follow the order of the values,
    so a feature has at most ``2 * bins`` of them, and they carry the rank sums as well as the bin counts. ``exact`` takes
    exact p-values for small classes.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if binning not in BINNINGS:
        raise ValueError(f"binning must be one of {BINNINGS}")
    validate_frame(df, [label, *features])
    buckets = bucket_count(df)
    profile = class_profile(df, features, label, buckets)
    ranges = _ranges(profile, binning == "shared")
    ranked = ranked_values(df, features, label, buckets, profile.select("feature", "cuts")).join(F.broadcast(ranges), "feature")
    place = [bin_index(F.col("value"), F.col(f"lo{c}"), F.col(f"hi{c}"), bins).alias(f"bin{c}") for c in (0, 1)]
    cells = ranked.select("*", *place).groupBy("feature", "bin0", "bin1").agg(
        *rank_sums(), F.sum("n0").alias("c0"), F.sum("n1").alias("c1")
    )
    rows = cells.groupBy("feature").agg(
        *[merge(c).alias(c) for c, merge in MERGED.items()], F.collect_list(F.struct("bin0", "bin1", "c0", "c1")).alias("cells")
    )
    rows = with_auc(rows.where(F.col("n_distinct") > 1)).join(F.broadcast(profile.join(ranges, "feature").drop("cuts")), "feature")

    def density(c: int) -> Column:
        def filled(b: Column) -> Column:
            own = F.filter("cells", lambda x: x[f"bin{c}"] == b)
            count = F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, x: acc + x[f"c{c}"])
            width = (F.col(f"hi{c}") - F.col(f"lo{c}")) / F.lit(float(bins))
            return F.greatest(count / (F.col(f"n{c}") * width), F.lit(FLOOR_DENSITY))

        return F.when(F.col(f"n{c}") > 0, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), filled))

    rows = with_divergence(rows.withColumn("p", density(0)).withColumn("q", density(1)))
    rows = rows.withColumn("effect_size", cohen_d_expression())
    if method == "ttest":
        tested, p = with_ttest(rows), "p_ttest"
    elif method == "ks":
        tested, p = with_ks(rows), "p_ks"
    else:
        tested, p = with_mannwhitney(rows), "p_mannwhitney"
    if exact and method != "ttest":
        keep = ["feature", "auc", "effect_size", "js_divergence", "n_background", "n_signal", "u_signal", "tied_pairs", "ks_d", p]
        tested = (exact_ks if method == "ks" else exact_mannwhitney)(tested.select(*keep))
    return (
        feature_list(df, features)
        .join(F.broadcast(tested), "feature")
        .select(
            "feature",
            "auc",
            "effect_size",
            F.col(p).alias("p_value"),
            significance_stars(F.col(p)).alias("stars"),
            "js_divergence",
        )
    )
