from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from classlens.operators import density, histogram, resampling
from classlens.plans.separation import separation_summary


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.35).astype(int)
    x = {"n": rng.normal(y, 1.0), "e": rng.exponential(1 + y), "t": rng.integers(0, 4, 600) * 1.0}
    rows = [(i, int(y[i]), *(float(x[f][i]) for f in x), 2.0) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, y int, n double, e double, t double, flat double")
    return df.cache(), y, x


def test_histogram_matches_numpy(sample):
    df, y, x = sample
    rows = histogram.class_histogram(df, ["n", "e"], "y", 20).collect()
    for f in ("n", "e"):
        for c in (0, 1):
            got = sorted((r["bin"], r["n"], r["density"], r["lo"]) for r in rows if (r["feature"], r["label"]) == (f, c))
            counts, edges = np.histogram(x[f][y == c], 20)
            dens, _ = np.histogram(x[f][y == c], 20, density=True)
            assert [g[1] for g in got] == counts.tolist()
            assert [g[2] for g in got] == pytest.approx(dens.tolist())
            assert [g[3] for g in got] == pytest.approx(edges[:-1].tolist())


def test_flat_range_is_widened(sample):
    df, _, _ = sample
    rows = histogram.distribution_histogram(df, "flat", 10).collect()
    assert len(rows) == 10 and sum(r["n"] for r in rows) == 600
    assert min(r["lo"] for r in rows) == 1.5 and max(r["hi"] for r in rows) == 2.5


def numpy_jsd(a, b, bins=50, **options):
    p = np.clip(np.histogram(a, bins, density=True, **options)[0], 1e-12, None)
    q = np.clip(np.histogram(b, bins, density=True, **options)[0], 1e-12, None)
    m = (p + q) / 2
    def kl(u):
        u, v = u / u.sum(), m / m.sum()
        return (u * np.log(u / v)).sum()
    return (kl(p) + kl(q)) / 2


def test_js_divergence(sample):
    df, y, x = sample
    own = {r[0]: r[1] for r in histogram.js_divergence(df, ["n", "e"], "y").collect()}
    both = {r[0]: r[1] for r in histogram.js_divergence(df, ["n", "e"], "y", binning="shared").collect()}
    for f in ("n", "e"):
        a, b = x[f][y == 0], x[f][y == 1]
        assert own[f] == pytest.approx(numpy_jsd(a, b), abs=1e-12)
        assert both[f] == pytest.approx(numpy_jsd(a, b, range=(x[f].min(), x[f].max())), abs=1e-12)
        assert both[f] <= math.log(2)
    with pytest.raises(ValueError):
        histogram.js_divergence(df, ["n"], "y", binning="other")


def test_js_divergence_of_equal_and_shifted_samples(spark):
    values = np.random.default_rng(0).normal(size=200)
    rows = [(c, float(v), float(v) + 100.0 * c) for v in values for c in (0, 1)]
    df = spark.createDataFrame(rows, "y int, same double, shifted double")
    own = {r[0]: r[1] for r in histogram.js_divergence(df, ["same", "shifted"], "y").collect()}
    shared = {r[0]: r[1] for r in histogram.js_divergence(df, ["same", "shifted"], "y", binning="shared").collect()}
    assert own["same"] < 1e-5 and shared["same"] < 1e-5
    assert shared["shifted"] == pytest.approx(math.log(2), abs=1e-6)


def test_kernel_density(sample):
    df, y, x = sample
    rows = density.kernel_density(df, ["n", "t", "flat"], "y").collect()
    assert {r["feature"] for r in rows} == {"n", "t"}
    for f in ("n", "t"):
        for c in (0, 1):
            v = x[f][y == c]
            bw = v.std(ddof=1) * len(v) ** -0.2
            grid = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 200)
            want = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
            got = sorted((r["point"], r["x"], r["density"]) for r in rows if (r["feature"], r["label"]) == (f, c))
            assert [g[1] for g in got] == pytest.approx(grid.tolist())
            assert [g[2] for g in got] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-14)


def test_trim_and_location(sample):
    df, y, x = sample
    trims = {r["feature"]: (r["lower"], r["upper"]) for r in histogram.trim_percentiles(df, ["n", "e"], "y").collect()}
    places = {(r["feature"], r["label"]): r for r in histogram.class_location(df, ["n", "t"], "y").collect()}
    for f in ("n", "e"):
        assert trims[f] == pytest.approx(tuple(np.percentile(x[f], [1, 99])))
    for f in ("n", "t"):
        for c in (0, 1):
            assert places[f, c]["mean"] == pytest.approx(x[f][y == c].mean())
            assert places[f, c]["median"] == pytest.approx(np.median(x[f][y == c]))


@pytest.mark.parametrize("tolerance", [1e-2, 1e-4, 1e-6])
def test_binned_density_keeps_its_bound(sample, tolerance):
    df, _, _ = sample
    exact = {(r["feature"], r["label"], r["point"]): r for r in density.kernel_density(df, ["n", "t", "flat"], "y").collect()}
    shapes = {(r["feature"], r["label"]): r for r in density.grid_shape(df, ["n", "t", "flat"], "y").collect()}
    binned = density.kernel_density(df, ["n", "t", "flat"], "y", method="binned", tolerance=tolerance).collect()
    assert len(binned) == len(exact) == 200 * len(shapes)
    for r in binned:
        height = 1.0 / (shapes[r["feature"], r["label"]]["bw"] * math.sqrt(2 * math.pi))
        assert abs(r["density"] - exact[r["feature"], r["label"], r["point"]]["density"]) <= tolerance * height + 1e-12
    with pytest.raises(ValueError):
        density.kernel_density(df, ["n"], method="fast")


def test_density_in_a_gap_is_not_zero(spark):
    """Every grid point sums every value: far from all of them the density is tiny, not missing."""
    df = spark.createDataFrame([(float(v),) for v in [0.0] * 40 + [1.0] * 40 + [30.0]], "v double")
    rows = density.kernel_density(df, ["v"]).collect()
    x = np.array([0.0] * 40 + [1.0] * 40 + [30.0])
    bw = x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-0.5 * ((r["x"] - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi)) for r in rows]
    assert [r["density"] for r in rows] == pytest.approx(want, rel=1e-9) and min(want) > 0


def test_stars(spark):
    df = spark.createDataFrame([(0.0005,), (0.001,), (0.02,), (0.05,), (None,)], "p double")
    stars = [r[0] for r in df.select(histogram.significance_stars(F.col("p"))).collect()]
    assert stars == ["***", "**", "*", "ns", "ns"]


@pytest.mark.parametrize("method", ["mannwhitney", "ks", "ttest"])
def test_separation_summary(sample, method):
    df, _, _ = sample
    rows = {r["feature"]: r for r in separation_summary(df, ["n", "e", "t", "flat"], "y", method).collect()}
    assert set(rows) == {"n", "e", "t"}  # the constant feature is left out
    assert rows["n"]["auc"] > 0.6 and rows["n"]["p_value"] < 1e-6 and rows["n"]["stars"] == "***"
    assert rows["n"]["effect_size"] < 0 <= rows["n"]["js_divergence"]
    with pytest.raises(ValueError):
        separation_summary(df, ["n"], "y", "anova")
    with pytest.raises(ValueError):
        separation_summary(df, ["n"], "nope")


def test_bootstrap_error(spark):
    rows = [("a",)] * 60 + [("b",)] * 30 + [(None,)] * 10
    df = spark.createDataFrame(rows, "label string")
    count = {r["label"]: r["error"] for r in resampling.bootstrap_error(df, "label").collect()}
    assert count == pytest.approx({"a": math.sqrt(100 * 0.6 * 0.4), "b": math.sqrt(100 * 0.3 * 0.7)})
    share = {r["label"]: r["error"] for r in resampling.bootstrap_error(df, "label", "percent").collect()}
    assert share["a"] == pytest.approx(math.sqrt((2 / 3) * (1 / 3) / 90))
    for stat, closed in (("count", count), ("percent", share)):
        drawn = resampling.bootstrap_error_simulated(df, "label", 20000, stat).collect()
        for r in drawn:
            assert r["error"] == pytest.approx(closed[r["label"]], rel=0.04)
    with pytest.raises(ValueError):
        resampling.bootstrap_error(df, "label", "mean")


@pytest.mark.parametrize("mean", [1.0, 2.0, 64.0, 65536.0, 2.0**17, 2.0**30])
def test_poisson_weights(mean):
    u = (np.arange(400_000) * (resampling.PRIME / 400_000) + resampling.PRIME / 800_000).astype(np.int64)
    if mean <= 2.0**resampling.TABLED_BITS:
        w = np.searchsorted(resampling.poisson_limits(mean), u, side="right")
    else:
        w = resampling._large_poisson(mean, u)
    assert w.mean() == pytest.approx(mean, rel=1e-3 / math.sqrt(mean)) and w.var() == pytest.approx(mean, rel=5e-3)
    skewness = ((w - w.mean()) ** 3).mean() / w.std() ** 3
    assert skewness == pytest.approx(1.0 / math.sqrt(mean), abs=0.02)


def test_bootstrap_mean_of_tied_values(spark):
    """The weights of equal rows are drawn together: the interval is as wide as with rows of their own."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 5, 5000) * 1.0
    df = spark.createDataFrame([(i, float(v), None) for i, v in enumerate(x)], "k long, v double, void double")
    found = resampling.bootstrap_ci_mean(df, ["v", "void"], n_boot=2000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan
    (row,) = found.collect()
    error = x.std() / math.sqrt(5000)
    assert row["lower"] == pytest.approx(x.mean() - 1.96 * error, abs=0.25 * error)
    assert row["upper"] == pytest.approx(x.mean() + 1.96 * error, abs=0.25 * error)
    assert found.collect() == [row]
    assert resampling.bootstrap_ci_mean(df.limit(0), ["v"]).collect() == []


def test_bootstrap_mean_interval(sample):
    df, _, x = sample
    rows = {r["feature"]: r for r in resampling.bootstrap_ci_mean(df, ["n", "e", "flat"], "k", 1000).collect()}
    # a 2.5 % quantile of 1,000 replicates has a standard error of 0.085 standard errors of the mean
    for f in ("n", "e"):
        error = x[f].std(ddof=1) / math.sqrt(600)
        assert rows[f]["lower"] == pytest.approx(x[f].mean() - 1.96 * error, abs=4 * 0.085 * error)
        assert rows[f]["upper"] == pytest.approx(x[f].mean() + 1.96 * error, abs=4 * 0.085 * error)
    assert rows["flat"]["lower"] == rows["flat"]["upper"] == 2.0


@pytest.mark.parametrize("n", [199, 200])
def test_bootstrap_median_interval(spark, n):
    rng = np.random.default_rng(4)
    v = np.sort(rng.normal(size=n))
    df = spark.createDataFrame([(float(a), None) for a in v] + [(None, None)], "v double, void double")
    drawn = np.median(rng.choice(v, (40000, n)), axis=1)
    want = np.percentile(drawn, [2.5, 97.5])
    at = np.searchsorted(v, want)
    for n_boot in (None, 20000):
        rows = resampling.bootstrap_ci_median(df, ["v", "void"], n_boot).collect()
        assert [r["lower"] for r in rows if r["feature"] == "void"] == [None]
        rows = [r for r in rows if r["feature"] == "v"]
        assert len(rows) == 1
        got = [rows[0]["lower"], rows[0]["upper"]]
        assert np.abs(np.searchsorted(v, got) - at).max() <= 1  # within one rank


def test_target_distribution(spark):
    df = spark.createDataFrame([(3,), (3,), (5,), (None,)], "c int")
    rows = {r["label"]: r for r in resampling.target_distribution(df, "c").collect()}
    assert rows["Background"]["value"] == 3 and rows["Signal"]["n"] == 1
    assert rows["Background"]["share"] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="exactly 2 distinct"):
        resampling.target_distribution(df.where("c = 3"), "c").collect()
