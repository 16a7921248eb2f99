from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from classlens.operators import quantile, ranked, twoclass
from classlens.operators.quantile import exact_quantiles, values_at_ranks
from classlens.operators.longform import long_form


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.4)
        tied = float(rng.integers(0, 6))
        hot = 7.0 if rng.random() < 0.4 else float(rng.normal())
        smooth = float(rng.normal(y * 0.5))
        gap = None if i % 7 == 0 else smooth * 2
        rows.append((i, y, tied, hot, smooth, gap if i % 11 else float("nan")))
    df = spark.createDataFrame(rows, "k int, y int, tied double, hot double, smooth double, gap double")
    return df.cache(), rows


FEATURES = ["tied", "hot", "smooth", "gap"]


def groups(rows, column):
    values = [(r[1], r[column]) for r in rows if r[column] is not None and not np.isnan(r[column])]
    return (
        np.array([v for y, v in values if y == 0]),
        np.array([v for y, v in values if y == 1]),
    )


@pytest.mark.parametrize("buckets", [1, 2, 16, 256])
def test_rank_statistics_match_brute_force(sample, buckets):
    df, rows = sample
    stats = ranked.rank_statistics(ranked.ranked_values(df, FEATURES, "y", buckets))
    found = {r["feature"]: r for r in stats.collect()}
    for i, f in enumerate(FEATURES):
        g0, g1 = groups(rows, i + 2)
        wins = (g1[:, None] > g0[None, :]).sum() + 0.5 * (g1[:, None] == g0[None, :]).sum()
        both = np.concatenate([g0, g1])
        _, t = np.unique(both, return_counts=True)
        d = max(abs((g0 <= v).mean() - (g1 <= v).mean()) for v in np.unique(both))
        r = found[f]
        assert (r["n_background"], r["n_signal"]) == (len(g0), len(g1))
        assert r["u_signal"] == wins
        assert r["auc"] == pytest.approx(wins / (len(g0) * len(g1)), abs=1e-14)
        assert r["tie_term"] == (t.astype(float) ** 3 - t).sum()
        assert r["ks_d"] == pytest.approx(d, abs=1e-14)


def test_cliffs_delta_matches_pairs(sample):
    df, rows = sample
    found = {r[0]: r[1] for r in twoclass.effect_size(df, FEATURES, "y", "cliffs_delta").collect()}
    for i, f in enumerate(FEATURES):
        g0, g1 = groups(rows, i + 2)
        delta = np.sign(g0[:, None] - g1[None, :]).sum() / (len(g0) * len(g1))
        assert found[f] == pytest.approx(delta, abs=1e-12)


def test_cohen_d_and_welch(sample):
    df, rows = sample
    d = {r[0]: r[1] for r in twoclass.effect_size(df, FEATURES, "y").collect()}
    t = {r["feature"]: r for r in twoclass.with_ttest(twoclass.class_moments(df, FEATURES, "y")).collect()}
    for i, f in enumerate(FEATURES):
        g0, g1 = groups(rows, i + 2)
        v0, v1 = g0.var(ddof=1), g1.var(ddof=1)
        assert d[f] == pytest.approx((g0.mean() - g1.mean()) / np.sqrt((v0 + v1) / 2))
        se = v0 / len(g0) + v1 / len(g1)
        assert t[f]["t"] == pytest.approx((g0.mean() - g1.mean()) / np.sqrt(se))
        df_ = se**2 / ((v0 / len(g0)) ** 2 / (len(g0) - 1) + (v1 / len(g1)) ** 2 / (len(g1) - 1))
        assert t[f]["df"] == pytest.approx(df_)


def test_shifted_group_is_separated(sample):
    df, _ = sample
    for method in twoclass.METHODS:
        found = {r[0]: r[1] for r in twoclass.feature_separation(df, FEATURES, "y", method).collect()}
        assert found["smooth"] < 0.05


def test_edge_cases(spark):
    df = spark.createDataFrame(
        [(0, 1.0, None, 5.0), (0, 2.0, None, 5.0), (1, 3.0, 2.0, 5.0), (1, 4.0, 3.0, 5.0), (None, 9.0, 1.0, 1.0)],
        "y int, clean double, one_class double, flat double",
    )
    features = ["clean", "one_class", "flat"]
    auc = {r["feature"]: r for r in twoclass.feature_auc(df, features, "y").collect()}
    assert auc["clean"]["auc"] == 1.0 and auc["clean"]["n_null"] == 0
    assert auc["one_class"]["auc"] is None and auc["one_class"]["n_null"] == 2
    assert auc["flat"]["auc"] == 0.5
    strict = {r["feature"]: r["auc"] for r in twoclass.feature_auc(df, features, "y", True).collect()}
    assert strict["clean"] == 1.0 and strict["one_class"] is None
    for method in (*twoclass.METHODS, "no such test"):
        p = {r["feature"]: r["p_value"] for r in twoclass.feature_separation(df, features, "y", method).collect()}
        assert set(p) == set(features)
        assert p["one_class"] is None
    with pytest.raises(ValueError):
        twoclass.effect_size(df, features, "y", "glass")


@pytest.mark.parametrize("exact_below,accuracy", [(20000, 10000), (0, 50), (0, 400)])
def test_exact_quantiles(spark, exact_below, accuracy):
    rng = np.random.default_rng(1)
    values = {
        "smooth": rng.normal(size=4001),
        "heavy": rng.exponential(size=4000) ** 6,
        "hot": np.where(rng.random(4000) < 0.4, 3.0, rng.normal(size=4000)),
        "tied": rng.integers(0, 4, 4000).astype(float),
        "flat": np.full(300, 2.0),
    }
    rows = [(f, float(v)) for f, vs in values.items() for v in vs] + [("smooth", None)]
    long = spark.createDataFrame(rows, "feature string, value double").repartition(7)
    probs = [0.5, 0.01, 0.25, 0.75, 0.99, 0.0, 1.0]
    found = exact_quantiles(long, probs, exact_below=exact_below, accuracy=accuracy).collect()
    assert {r["feature"] for r in found} == set(values)
    for r in found:
        want = np.quantile(values[r["feature"]], probs)
        assert r["n"] == len(values[r["feature"]])
        assert r["quantiles"] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("wrong", ["shifted", "narrow", "far"])
def test_wrong_brackets_are_widened(spark, monkeypatch, wrong):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    long = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", 2.0)], "feature string, value double")
    tries = []

    def sketch(source, keys, marks, accuracy):
        tries.append(marks)
        low = {"shifted": 0.7, "narrow": 0.25, "far": 1e6}[wrong] if len(tries) < 3 else None
        exact = source.groupBy(*keys).agg(F.count("value").alias("n"), F.percentile_approx("value", F.lit(marks), 10_000).alias("marks"))
        if wrong != "far" and low is None:
            return exact
        return exact.withColumn("marks", F.array(*[F.lit(float(low or 1e6) + i * 1e-9) for i in range(len(marks))]))

    monkeypatch.setattr(quantile, "_sketched", sketch)
    found = {r["feature"]: r["quantiles"] for r in exact_quantiles(long, [0.1, 0.9], exact_below=0).collect()}
    assert found["a"] == pytest.approx(np.quantile(x, [0.1, 0.9]).tolist()) and found["b"] == pytest.approx([1.1, 1.9])
    assert len(tries) > 1


def test_small_groups_have_exact_quantiles(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 1, 5.0), ("b", 0, None)]
    long = spark.createDataFrame(rows, "feature string, label int, value double")
    found = exact_quantiles(long, [0.5], ["feature", "label"]).collect()
    assert {(r["feature"], r["label"], r["quantiles"][0]) for r in found} == {("a", 0, 1.0), ("a", 1, 3.5)}


def test_values_at_ranks(spark):
    ranked_rows = spark.createDataFrame(
        [("f", 10.0, 0, 3), ("f", 20.0, 3, 4), ("f", 30.0, 4, 9)],
        "feature string, value double, before bigint, after bigint",
    )
    targets = spark.createDataFrame(
        [("f", 0, 2), ("f", 1, 3), ("f", 2, 8), ("f", 3, 2)], "feature string, b int, rank bigint"
    )
    found = {r["b"]: r["value"] for r in values_at_ranks(ranked_rows, targets).collect()}
    assert found == {0: 10.0, 1: 20.0, 2: 30.0, 3: 10.0}


def test_long_form_drops_missing(sample):
    df, rows = sample
    counts = {r[0]: r[1] for r in long_form(df, FEATURES, "y").groupBy("feature").count().collect()}
    assert counts["gap"] == len(np.concatenate(groups(rows, 5)))
    assert counts["tied"] == 900


def test_bucket_cuts_do_not_depend_on_rows(sample):
    df, _ = sample
    cuts = ranked.bucket_cuts(df, FEATURES, 8).collect()
    assert all(len(r["cuts"]) == 7 and r["cuts"] == sorted(r["cuts"]) for r in cuts)
    bucketed = ranked.with_bucket(
        long_form(df, FEATURES, "y"), ranked.bucket_cuts(df, FEATURES, 8), 8
    )
    by_feature = {r["feature"]: r["cuts"] for r in cuts}
    for r in bucketed.where(F.col("feature") == "smooth").take(50):
        assert r["bucket"] == sum(c < r["value"] for c in by_feature["smooth"])
