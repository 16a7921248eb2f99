"""Correlations: Pearson, Spearman and Kendall's tau-b, with pairwise deletion of nulls."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.longform import every_feature, feature_list, melt, numeric_columns, validate_frame
from classlens.operators.rank_correlation import kendall_pairs, spearman_pairs
from classlens.operators.ranked import rank_statistics, ranked_values
from classlens.sources.workdir import stage

METHODS = ("pearson", "spearman", "kendall")
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
CONSTANT = 1e-12


def _gram_sums(names: list[str], group: str | None):
    """Per task: masked cross products of all column pairs, one row per (group, pair)."""
    left, right = np.triu_indices(len(names), k=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            parts = batch.groupby(group) if group else [(0, batch)]
            for key, part in parts:
                x = part[names].to_numpy(dtype=float)
                seen = (~np.isnan(x)).astype(float)
                z = np.nan_to_num(x)
                sums = np.stack([seen.T @ seen, z.T @ seen, (z * z).T @ seen, z.T @ z])
                totals[key] = totals.get(key, 0.0) + sums
        for key, (n, s, q, c) in totals.items():
            yield pd.DataFrame(
                {
                    "grp": key,
                    "a": left,
                    "b": right,
                    "n": n[left, right],
                    "sx": s[left, right],
                    "sy": s[right, left],
                    "sxx": q[left, right],
                    "syy": q[right, left],
                    "sxy": c[left, right],
                }
            )

    return run


def _r_from_sums() -> Column:
    """Pearson's r from centred sums; NULL when a side is constant on the pair's rows."""
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cxy = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    varies = (vx > CONSTANT * F.col("sxx")) & (vy > CONSTANT * F.col("syy"))
    r = F.try_divide(cxy, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    return F.when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def pearson_pairs(
    df: DataFrame, columns: Sequence[str], group: str | None = None, centre: bool = True
) -> DataFrame:
    """``([group,] col_a, col_b, n, r)`` for all pairs, ``col_a`` before ``col_b`` in column order.

    Columns are shifted by their mean (one aggregate; one value per column on the driver), then every
    task reduces its rows to one cross-product row per pair. ``centre=False`` saves the first pass where
    the mean is no larger than the spread, as for ranks.
    """
    columns = list(columns)
    wide = df.select(
        *([F.col(group).alias("grp")] if group else []),
        *[clean_double(c).alias(c) for c in columns],
    )
    if group:
        wide = wide.where(F.col("grp").isNotNull())
    shifted = wide
    if centre:
        means = wide.agg(*[F.avg(c).alias(c) for c in columns]).first()
        shifted = wide.select(
            *(["grp"] if group else []),
            *[(F.col(c) - F.lit(means[c] or 0.0)).alias(c) for c in columns],
        )
    kind = df.schema[group].dataType.simpleString() if group else "int"
    schema = f"grp {kind}, a int, b int, " + ", ".join(f"{s} double" for s in SUMS)
    partial = shifted.mapInPandas(_gram_sums(columns, "grp" if group else None), schema)
    sums = partial.groupBy("grp", "a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        *([F.col("grp").alias(group)] if group else []),
        F.get(names, F.col("a")).alias("col_a"),
        F.get(names, F.col("b")).alias("col_b"),
        F.col("n").cast("bigint").alias("n"),
        _r_from_sums().alias("r"),
    )


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], method: str = "pearson", key: str | None = None, group: str | None = None
) -> DataFrame:
    """``([group,] col_a, col_b, n, r)`` by ``method``, inside each class of ``group``; the rank methods need a unique ``key``."""
    if method == "pearson":
        return pearson_pairs(df, columns, group)
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if key is None:
        raise ValueError(f"{method} needs a unique key column")
    return (spearman_pairs if method == "spearman" else kendall_pairs)(df, columns, key, group)


def kendall_with_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, r)``: tau-b with a binary label, in closed form from the ranked value table."""
    n0, n1 = F.col("n_background").cast("double"), F.col("n_signal").cast("double")
    n = n0 + n1
    untied = (n * (n - 1.0) / 2.0 - F.col("tied_pairs")) * n0 * n1
    stats = rank_statistics(ranked_values(df, features, label))
    tau = F.try_divide((2.0 * F.col("auc") - 1.0) * n0 * n1, F.sqrt(untied))
    return stats.select("feature", F.when(untied > 0, tau).alias("r"))


def spearman_with_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, r)``: Spearman's rho with a binary label, in closed form from the ranked table."""
    n0, n1 = F.col("n_background").cast("double"), F.col("n_signal").cast("double")
    n = n0 + n1
    rank_spread = (n * n * n - n - F.col("tie_term")) / 12.0
    shift = (F.col("auc") - 0.5) * n0 * n1
    rho = F.try_divide(shift, F.sqrt(rank_spread * F.try_divide(n0 * n1, n)))
    stats = rank_statistics(ranked_values(df, features, label))
    return stats.select("feature", F.when(rank_spread > 0, rho).alias("r"))


def _numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with a row number as key, staged so that every reader sees the same numbers."""
    chosen = [F.col(f"`{c}`") for c in dict.fromkeys(columns)]
    return stage(df.select(F.monotonically_increasing_id().alias("_row"), *chosen), "ranked-target")


def _classes(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """``(class, feature, ordinal)``: every feature in every class; rows without a class make none."""
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ordinal")) for i, f in enumerate(features)])
    found = df.where(F.col(f"`{group}`").isNotNull()).select(F.col(f"`{group}`").alias("class")).distinct()
    return found.select("class", F.inline(listed))


def target_correlations(
    df: DataFrame, features: Sequence[str], target: str, method: str = "pearson", group: str | None = None
) -> DataFrame:
    """``([class,] feature, r)`` of every feature with the target; no feature pairs are formed.

    Rank methods use closed forms for a target of 0 and 1; any other numeric target is ranked once, together with
    all features. With ``group`` each class of that column is looked at by itself. A feature without a defined
    correlation gets NULL; inside a class of the target itself that is every feature.
    """
    if method not in ("pearson", *METHODS):
        raise ValueError(f"unknown method: {method}")
    if group == target:
        return _classes(df, group, features).select("class", "feature", F.lit(None).cast("double").alias("r"))
    if method != "pearson":
        binary = not group and df.where(F.col(target).isNotNull() & ~F.col(target).isin(0, 1)).isEmpty()
        if binary:
            closed = kendall_with_label if method == "kendall" else spearman_with_label
            return every_feature(df, features, closed(df, features, target))
        rows = _numbered(df, *features, target, *([group] if group else []))
        pairs = (spearman_pairs if method == "spearman" else kendall_pairs)(rows, [*features, target], "_row", group, target)
        found = pairs.withColumnRenamed("col_a", "feature")
    else:
        y = clean_double(target)
        by = ["class"] if group else []
        own = [F.col(f"`{group}`").alias("class")] if group else []
        wide = df.select(*own, y.alias("_y"), *[clean_double(f).alias(f) for f in features])
        long = melt(wide.where(F.col("_y").isNotNull()), [*by, "_y"], features)
        sums = (
            long.where(F.col("value").isNotNull())
            .groupBy(*by, "feature")
            .agg(
                F.covar_pop("value", "_y").alias("c"),
                F.stddev_pop("value").alias("sx"),
                F.stddev_pop("_y").alias("sy"),
                (F.max("value") > F.min("value")).alias("vx"),
                (F.max("_y") > F.min("_y")).alias("vy"),
            )
        )
        r = F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))
        found = sums.withColumn("r", F.when(F.col("vx") & F.col("vy"), r))
    if not group:
        return every_feature(df, features, found.select("feature", "r"))
    found = found.withColumnRenamed(group, "class").select("class", "feature", "r")
    return _classes(df, group, features).join(found, ["class", "feature"], "left").select("class", "feature", "r")


def _class_column(df: DataFrame, target: str, per_class: bool | str) -> str | None:
    validate_frame(df, [target, *([per_class] if isinstance(per_class, str) else [])])
    if target not in numeric_columns(df):
        raise ValueError(f"target column '{target}' must be numeric")
    return per_class if isinstance(per_class, str) else target if per_class else None


def top_correlations(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    top_n: int = 10,
    method: str = "pearson",
    positive_only: bool = False,
    negative_only: bool = False,
    per_class: bool | str = False,
) -> DataFrame:
    """The ``top_n`` features by |r| with the target, sign kept; ties in order of the name.

    With ``per_class`` a table ``(class, feature, r)`` of the top features inside each class: the classes of the target
    (True) or of another column (its name). Features without a correlation come last there, in their own order; inside
    a class of the target these are all, as the target is constant.
    """
    group = _class_column(df, target, per_class)
    return _best(target_correlations(df, features, target, method, group), features, top_n, positive_only, negative_only, bool(group))


def _best(
    found: DataFrame, features: Sequence[str], top_n: int, positive_only: bool, negative_only: bool, grouped: bool
) -> DataFrame:
    """The ``top_n`` rows of ``found([class,] feature, r)``, in all or in each class."""
    if positive_only:
        found = found.where(F.col("r") > 0)
    elif negative_only:
        found = found.where(F.col("r") < 0)
    if not grouped:
        return found.where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "feature").limit(top_n)
    order = F.create_map(*[F.lit(x) for pair in zip(features, range(len(features))) for x in pair])
    late = F.when(F.col("r").isNull(), F.element_at(order, F.col("feature")))
    best = Window.partitionBy("class").orderBy(F.desc_nulls_last(F.abs("r")), late, "feature")
    return found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top_n).drop("_place")


def _with_itself(df: DataFrame, columns: Sequence[str], group: str, method: str) -> DataFrame:
    """``(class, col_a, col_b, r)`` of each column with itself: 1, for Pearson and Spearman NULL where it is constant."""
    wide = df.where(F.col(f"`{group}`").isNotNull()).select(
        F.col(f"`{group}`").alias("class"), *[clean_double(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    spans = wide.groupBy("class").agg(
        *[(F.max(f"c{i}") > F.min(f"c{i}")).alias(f"c{i}") for i in range(len(columns))]
    )
    one = lambda i: F.lit(1.0) if method == "kendall" else F.when(F.col(f"c{i}"), 1.0)
    cells = [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), one(i).alias("r")) for i, c in enumerate(columns)]
    return spans.select("class", F.inline(F.array(*cells)))


def correlation_submatrix(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    top_n: int = 10,
    method: str = "pearson",
    key: str | None = None,
    positive_only: bool = False,
    negative_only: bool = False,
    per_class: bool | str = False,
) -> DataFrame:
    """``([class,] col_a, col_b, r)``: full square matrix of the top features and the target.

    With ``per_class`` one matrix for each class, with the features that ``top_correlations`` gives there; nothing about
    the classes reaches the driver. Inside a class of the target the columns are the first ``top_n`` features and the
    target, whose correlations are NULL.
    """
    group = _class_column(df, target, per_class)
    if not group:
        top = top_correlations(df, features, target, top_n, method, positive_only, negative_only)
        chosen = {r["feature"] for r in top.select("feature").collect()}
        columns = [f for f in features if f in chosen] + [target]
        upper = correlation_pairs(df, columns, method, key).select("col_a", "col_b", "r")
        lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
        own = feature_list(df, columns).select(
            F.col("feature").alias("col_a"), F.col("feature").alias("col_b"), F.lit(1.0).alias("r")
        )
        return upper.unionByName(lower).unionByName(own)
    columns = [*features, target]
    if group == target:
        columns = [*([] if positive_only or negative_only else features[:top_n]), target]
    by_class = df.withColumn("_class", F.col(f"`{group}`"))
    pairs = correlation_pairs(by_class, columns, method, key, "_class").withColumnRenamed("_class", "class")
    pairs = stage(pairs, "pairs")  # a row per class and pair
    upper = pairs.select("class", "col_a", "col_b", "r")
    lower = upper.select("class", F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    cells = upper.unionByName(lower).unionByName(_with_itself(by_class, columns, "_class", method))
    if group == target:
        return cells
    if method == "pearson":
        top = top_correlations(df, features, target, top_n, method, positive_only, negative_only, per_class)
    else:  # the target is the last column of the pairs
        ranked = upper.where(F.col("col_b") == target).select("class", F.col("col_a").alias("feature"), "r")
        listed = _classes(by_class, "_class", features).select("class", "feature")
        top = _best(listed.join(ranked, ["class", "feature"], "left"), features, top_n, positive_only, negative_only, True)
    kept = top.select("class", "feature").unionByName(_classes(by_class, "_class", [target]).select("class", "feature"))
    left, right = kept.withColumnRenamed("feature", "col_a"), kept.withColumnRenamed("feature", "col_b")
    return cells.join(left, ["class", "col_a"]).join(right, ["class", "col_b"]).select("class", "col_a", "col_b", "r")


def redundant_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """``(later, earlier, r)``: pairs whose absolute Pearson correlation exceeds the threshold."""
    return (
        pearson_pairs(df, columns)
        .where(F.abs("r") > threshold)
        .select(F.col("col_b").alias("later"), F.col("col_a").alias("earlier"), "r")
    )
