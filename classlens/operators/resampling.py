"""Bootstrap errors and confidence intervals."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double, hash_digits
from classlens.operators.longform import every_feature, long_form
from classlens.operators.quantile import values_at_ranks
from classlens.operators.ranked import bucket_count, bucket_cuts, running_counts, with_bucket

STATS = ("count", "percent")
PRIME = 2**31 - 1


def _stat_checked(stat: str) -> str:
    if stat not in STATS:
        raise ValueError(f"stat must be one of {STATS}")
    return stat


def _label_counts(df: DataFrame, column: str) -> DataFrame:
    """``(label, c, n, filled)``: count of each value, all rows, rows with a value."""
    counts = df.groupBy(F.col(column).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("c")
    )
    sizes = counts.agg(
        F.struct(
            F.sum("c").alias("n"), F.sum(F.when(F.col("label").isNotNull(), F.col("c"))).alias("f")
        ).alias("s")
    ).scalar()
    return counts.where(F.col("label").isNotNull()).select(
        "label", "c", sizes.getField("n").alias("n"), sizes.getField("f").alias("filled")
    )


def closed_form_error(c: Column, n: Column, filled: Column, stat: str) -> Column:
    """Standard deviation of a resampled count or share: the limit of infinitely many resamples.

    Resampling rows with replacement makes the count of one label binomial.
    """
    if _stat_checked(stat) == "count":
        share = c / n
        return F.sqrt(n * share * (1.0 - share))
    share = c / filled
    return F.sqrt(share * (1.0 - share) / filled)


def bootstrap_error(df: DataFrame, column: str, stat: str = "count") -> DataFrame:
    """``(label, n, error)`` for every value of a categorical column."""
    error = closed_form_error(F.col("c"), F.col("n"), F.col("filled"), stat)
    return _label_counts(df, column).select("label", F.col("c").alias("n"), error.alias("error"))


def bootstrap_error_simulated(
    df: DataFrame, column: str, n_boot: int = 1000, stat: str = "count", seed: int = 42
) -> DataFrame:
    """``(label, n, error)`` from ``n_boot`` seeded draws on the table of label counts."""
    _stat_checked(stat)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for label, c, n, filled in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(label.encode())])
                present = rng.binomial(n, filled / n, n_boot)
                hits = rng.binomial(present, c / filled)
                if stat == "percent":
                    hits = hits / np.maximum(present, 1)
                errors.append(float(np.std(hits)) if n_boot else None)
            yield pd.DataFrame({"label": batch["label"], "n": batch["c"], "error": errors})

    return _label_counts(df, column).mapInPandas(draw, "label string, n bigint, error double")


#: Counts are split into powers of two; beyond this one a power is drawn from the expansion for large means.
TABLED_BITS = 16
#: Weights that a task holds at a time.
DRAWS = 1 << 19


def poisson_limits(mean: float) -> np.ndarray:
    """Ascending limits: a uniform integer in [0, PRIME) stands for the Poisson weight that is the number of limits up to it."""
    reach = 12.0 * math.sqrt(mean) + 30.0
    first = max(0, math.floor(mean - reach))
    weights = np.arange(first, math.ceil(mean + reach) + 1)
    logs = weights * math.log(mean) - mean - np.array([math.lgamma(w + 1.0) for w in weights])
    cdf = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return np.concatenate([np.zeros(first, np.int64), np.floor(cdf * PRIME).astype(np.int64)])


def _large_poisson(mean: float, u: np.ndarray) -> np.ndarray:
    """Cornish-Fisher inversion for a mean of 2 ** 17 or more, where its error is far below one."""
    normal = NormalDist()
    grid = np.linspace(-6.5, 6.5, 4097)
    z = np.interp((u + 0.5) / PRIME, np.array([normal.cdf(x) for x in grid]), grid)
    return np.maximum(np.rint(mean + math.sqrt(mean) * z + (z * z - 1.0) / 6.0), 0.0)


def _weighted_sums(n_boot: int):
    """Per task: the weighted sum and the sum of weights of every feature and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        totals: dict[str, np.ndarray] = {}
        replicate = np.arange(n_boot, dtype=np.int64)
        step = max(1, DRAWS // max(n_boot, 1))

        def draws(h: np.ndarray, bit: int) -> np.ndarray:
            x = replicate + bit * n_boot
            u = h[:, :1]
            for i in range(1, 4):
                u = (u * x + h[:, i : i + 1]) % PRIME
            if bit > TABLED_BITS:
                return _large_poisson(2.0**bit, u)
            if bit not in tables:
                tables[bit] = poisson_limits(2.0**bit)
            return np.searchsorted(tables[bit], u, side="right").astype(np.float64)

        for batch in batches:
            names = batch.column("feature").to_pylist()
            value, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("value", "c"))
            h = np.stack([batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            feature = np.array(names)
            for name in dict.fromkeys(names):
                total = totals.setdefault(name, np.zeros((2, n_boot)))
                own = np.flatnonzero(feature == name)
                for bit in range(int(c[own].max()).bit_length()):
                    some = own[(c[own] >> bit) & 1 == 1]
                    for at in range(0, len(some), step):
                        rows = some[at : at + step]
                        w = draws(h[rows], bit)
                        total[0] += value[rows] @ w
                        total[1] += w.sum(axis=0)
        for name, total in totals.items():
            columns = [pa.array([name] * n_boot), pa.array(replicate), pa.array(total[0]), pa.array(total[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "b", "total", "n"])

    return run


def bootstrap_ci_mean(
    df: DataFrame,
    features: Sequence[str],
    key: str | None = None,
    n_boot: int = 1000,
    ci: float = 95.0,
    seed: int = 42,
) -> DataFrame:
    """``(feature, lower, upper)``: percentile interval of the mean by Poisson bootstrap.

    The rows that share a value get the sum of their Poisson(1) weights at once: Poisson(c) for c rows, drawn as a sum
    over the powers of two of which c consists. So the work grows with the distinct values, whatever the number of
    rows. Weights are functions of the feature and of the number of smaller values, so a lost task recomputes the same
    ones: the digest of both gives a cubic polynomial modulo a prime, whose values at the replicates (and powers) are
    4-wise independent. A task's replicates are one matrix product; the shuffle carries ``n_boot`` rows per task and
    feature. ``key`` is not needed and kept for older callers. A feature without values has no row.
    """
    place = F.concat_ws("|", "feature", F.col("before").cast("string"))
    rows = _ranked_positions(df, features).select(
        "feature",
        "value",
        (F.col("after") - F.col("before")).alias("c"),
        *[(hash_digits(place, seed, part) % PRIME).alias(f"h{part}") for part in range(4)],
    )
    partial = rows.mapInArrow(_weighted_sums(n_boot), "feature string, b bigint, total double, n double")
    sums = partial.groupBy("feature", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _interval(sums.select("feature", F.try_divide("total", "n").alias("stat")), ci)


def _interval(replicates: DataFrame, ci: float) -> DataFrame:
    low = (100.0 - ci) / 200.0
    return replicates.groupBy("feature").agg(
        F.percentile("stat", F.lit(low)).alias("lower"),
        F.percentile("stat", F.lit(1.0 - low)).alias("upper"),
    )


def _ranked_positions(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, value, before, after, n)``: 0-based rank range of every distinct value."""
    buckets = bucket_count(df)
    counts = long_form(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    bucketed = with_bucket(counts, bucket_cuts(df, features, buckets), buckets)
    return running_counts(bucketed, ["feature"], ["bucket"], ["c"]).select(
        "feature",
        "value",
        F.col("before_c").alias("before"),
        (F.col("before_c") + F.col("c")).alias("after"),
        F.col("total_c").alias("n"),
    )


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    terms = 200 + int(4.0 * math.sqrt(max(a, b)))
    value = 1.0
    for k in range(terms, 0, -1):
        m = k // 2
        if k % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + d / value
    return front / (a * value)


def order_rank(n: int, k: int, q: float) -> int:
    """0-based rank that the k-th smallest of n draws from ranks 1..n reaches with probability q."""
    low, high = 1, n
    while low < high:
        middle = (low + high) // 2
        if beta_tail(middle / n, k, n - k + 1) >= q:
            high = middle
        else:
            low = middle + 1
    return low - 1


def bootstrap_ci_median(
    df: DataFrame,
    features: Sequence[str],
    n_boot: int | None = None,
    ci: float = 95.0,
    seed: int = 42,
) -> DataFrame:
    """``(feature, lower, upper)``: percentile interval of the resampled median, without resampling.

    A resample's k-th smallest value is the value at rank ceil(n U), U ~ Beta(k, n - k + 1), so one ranking
    pass serves any number of replicates. With ``n_boot`` the ranks are drawn (both middle ranks jointly
    when n is even). Without it the interval of infinitely many replicates is read off the binomial law;
    for even n the quantiles of the two middle ranks are averaged.
    """
    ranked = _ranked_positions(df, features)
    sizes = ranked.groupBy("feature").agg(F.max("n").alias("n"))
    low = (100.0 - ci) / 200.0

    def limit_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (feature, b, order_rank(n, k, q))
                for feature, n in batch.itertuples(index=False)
                for b, q in enumerate((low, 1.0 - low))
                for k in ((n + 1) // 2, n // 2 + 1)
            ]
            yield pd.DataFrame(rows, columns=["feature", "b", "rank"])

    def drawn_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for feature, n in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(feature.encode())])
                k = n // 2
                upper = rng.beta(k + 1, n - k, n_boot)
                lower = upper if n % 2 else upper * rng.random(n_boot) ** (1.0 / k)
                for u in (lower, upper):
                    rank = np.clip(np.ceil(u * n).astype("int64") - 1, 0, n - 1)
                    yield pd.DataFrame({"feature": feature, "b": np.arange(n_boot), "rank": rank})

    ranks = limit_ranks if n_boot is None else drawn_ranks
    targets = sizes.mapInPandas(ranks, "feature string, b int, rank bigint")
    medians = (
        values_at_ranks(ranked, targets).groupBy("feature", "b").agg(F.avg("value").alias("stat"))
    )
    if n_boot is not None:
        return every_feature(df, features, _interval(medians.select("feature", "stat"), ci))
    limits = medians.groupBy("feature").agg(
        F.max(F.when(F.col("b") == 0, F.col("stat"))).alias("lower"),
        F.max(F.when(F.col("b") == 1, F.col("stat"))).alias("upper"),
    )
    return every_feature(df, features, limits)


def bootstrap_ci(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    stat: str = "mean",
    n_boot: int = 1000,
    ci: float = 95.0,
    seed: int = 42,
) -> DataFrame:
    """``(feature, lower, upper)``: percentile bootstrap interval of the mean or the median."""
    if stat == "mean":
        return bootstrap_ci_mean(df, features, key, n_boot, ci, seed)
    if stat == "median":
        return bootstrap_ci_median(df, features, n_boot, ci, seed)
    raise ValueError(f"unknown statistic: {stat}")


def target_distribution(df: DataFrame, column: str, stat: str = "count") -> DataFrame:
    """``(label, value, n, share, error)`` of a two-valued column; ``share`` is in [0, 1].

    The smaller value is the background, the larger one the signal. Any other number of distinct values
    is an error.
    """
    _stat_checked(stat)
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    filled = counts.where(F.col("value").isNotNull())
    sizes = counts.agg(F.sum("c").alias("n"))
    first_three = filled.orderBy("value").limit(3)
    cells = F.array_sort(F.collect_list(F.struct("value", "c")))
    wrong = F.raise_error(F.lit(f"column '{column}' must have exactly 2 distinct values"))
    table = first_three.agg(cells.alias("cells")).select(
        sizes.scalar().alias("n"),
        F.when(F.size("cells") != 2, wrong).otherwise(F.col("cells")).alias("cells"),
    )
    checked = table.select(
        "n",
        (F.col("cells")[0]["c"] + F.col("cells")[1]["c"]).alias("filled"),
        F.posexplode("cells"),
    )
    c = F.col("col.c")
    return checked.select(
        F.when(F.col("pos") == 0, "Background").otherwise("Signal").alias("label"),
        F.col("col.value").alias("value"),
        c.alias("n"),
        (c / F.col("filled")).alias("share"),
        closed_form_error(c, F.col("n"), F.col("filled"), stat).alias("error"),
    )
