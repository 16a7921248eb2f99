from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from classlens.operators import correlation, multitest, neighbours, projection, twoclass


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(9)
    n = 500
    a = rng.normal(size=n)
    pdf = pd.DataFrame(
        {
            "k": np.arange(n),
            "y": (rng.random(n) < 0.4).astype(int),
            "a": a,
            "b": a * 1.01 + 1e6,
            "c": -a + rng.normal(size=n),
            "t": rng.integers(0, 5, n) * 1.0,
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
            "flat": 0.1,
        }
    )
    holes = pdf.copy()
    holes.loc[::4, "a"] = np.nan
    holes.loc[::7, "t"] = np.nan
    return spark.createDataFrame(pdf).cache(), pdf, spark.createDataFrame(holes).cache(), holes


COLUMNS = ["a", "b", "c", "t", "hot", "flat", "y"]


def check(found, pdf, columns, method):
    want = pdf[columns].rank().corr() if method == "spearman" else pdf[columns].corr()
    seen = set()
    for r in found.collect():
        i, j = columns.index(r["col_a"]), columns.index(r["col_b"])
        assert i < j
        seen.add((i, j))
        expected = want.iloc[i, j]
        if method == "spearman":
            both = pdf[[columns[i], columns[j]]].dropna().rank()
            expected = both.corr().iloc[0, 1]
        if "flat" in (r["col_a"], r["col_b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(expected, abs=1e-9)
    assert len(seen) == len(columns) * (len(columns) - 1) // 2


def test_pearson(sample):
    df, pdf, holes_df, holes = sample
    check(correlation.pearson_pairs(df, COLUMNS), pdf, COLUMNS, "pearson")
    check(correlation.pearson_pairs(holes_df, COLUMNS), holes, COLUMNS, "pearson")


def test_spearman(sample):
    df, pdf, holes_df, holes = sample
    check(correlation.spearman_pairs(df, COLUMNS, "k"), pdf, COLUMNS, "spearman")
    columns = ["a", "t", "hot"]
    check(correlation.spearman_pairs(holes_df, columns, "k"), holes, columns, "spearman")


def tau_b(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    s = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])
    nx, ny = (x[:, None] != x[None, :]).sum(), (y[:, None] != y[None, :]).sum()
    return s.sum() / np.sqrt(float(nx) * float(ny)) if nx and ny else None


def test_kendall(sample):
    df, pdf, holes_df, holes = sample
    for frame, values in ((df, pdf), (holes_df, holes)):
        columns = ["a", "t", "hot", "y", "flat"]
        for r in correlation.kendall_pairs(frame, columns, "k").collect():
            want = tau_b(values[r["col_a"]].to_numpy(float), values[r["col_b"]].to_numpy(float))
            assert r["r"] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_correlation_with_label(sample):
    df, pdf, _, _ = sample
    features = ["a", "t", "hot", "flat"]
    y = pdf["y"].to_numpy(float)
    for r in correlation.kendall_with_label(df, features, "y").collect():
        want = tau_b(pdf[r["feature"]].to_numpy(float), y)
        assert r["r"] == (want if want is None else pytest.approx(want, abs=1e-12))
    for method in ("pearson", "spearman"):
        for r in correlation.target_correlations(df, features, "y", method).collect():
            x = pdf[r["feature"]].rank() if method == "spearman" else pdf[r["feature"]]
            if r["feature"] == "flat":
                assert r["r"] is None
            else:
                assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-10)


def test_per_class(sample):
    df, pdf, _, _ = sample
    for r in correlation.pearson_pairs(df, ["a", "c", "y"], "y").collect():
        if r["col_b"] == "y":
            assert r["r"] is None  # the target is constant inside a class
        else:
            assert r["r"] == pytest.approx(pdf[pdf["y"] == r["y"]][["a", "c"]].corr().iloc[0, 1])


def test_top_and_submatrix(sample):
    df, pdf, _, _ = sample
    features = ["a", "c", "t", "hot"]
    want = pdf[features].corrwith(pdf["y"])
    top = correlation.top_correlations(df, features, "y", 2).collect()
    assert [r["feature"] for r in top] == want.abs().sort_values(ascending=False).index[:2].tolist()
    assert all(r["r"] > 0 for r in correlation.top_correlations(df, features, "y", 9, positive_only=True).collect())
    assert all(r["r"] < 0 for r in correlation.top_correlations(df, features, "y", 9, negative_only=True).collect())
    square = correlation.correlation_submatrix(df, features, "y", 2).collect()
    assert len(square) == 9
    with pytest.raises(ValueError):
        correlation.top_correlations(df, features, "y", method="cosine")
    with pytest.raises(ValueError):
        correlation.top_correlations(df.withColumn("s", df.y.cast("string")), features, "s")


def test_redundant(sample):
    df, _, _, _ = sample
    found = [(r["later"], r["earlier"]) for r in correlation.redundant_pairs(df, ["a", "b", "c", "flat"], 0.9).collect()]
    assert found == [("b", "a")]


def test_correlation_methods(sample):
    df, _, _, _ = sample
    assert correlation.correlation_pairs(df, ["a", "t"], "kendall", "k").count() == 1
    for options in (("cosine", "k"), ("spearman", None)):
        with pytest.raises(ValueError):
            correlation.correlation_pairs(df, ["a", "t"], *options)


def test_pca(sample):
    df, pdf, _, _ = sample
    features = ["a", "b", "c", "t", "flat"]
    x = pdf[features].to_numpy(float)
    sd = x.std(0)
    sd[-1] = 1.0
    z = (x - x.mean(0)) / sd
    z[:, -1] = 0.0
    values, loadings = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1][:2]
    loadings = loadings[:, order]
    loadings *= np.sign(loadings[np.abs(loadings).argmax(0), [0, 1]])
    got = projection.pca_scores(df, features, ["k"]).toPandas().set_index("k").sort_index()
    assert np.abs(got.to_numpy() - z @ loadings).max() < 1e-6
    ratios = [r["ratio"] for r in projection.pca_explained_variance(df, features).collect()]
    assert ratios == pytest.approx((values[order] / values.sum()).tolist())


def brute_neighbours(x, ids, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((round(d[i, j], 9), ids[j]) for j in range(len(x)) if j != i)[:k]
        out[ids[i]] = order
    return out


@pytest.mark.parametrize("copies", [0, 120])
@pytest.mark.parametrize("block,pivots", [(2048, 1024), (40, 5)])
def test_neighbours(spark, copies, block, pivots):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(8, 0.5, size=(90, 3)), np.tile([[3.0, 1.0, 2.0]], (copies, 1))])
    pdf = pd.DataFrame(x, columns=["p", "q", "r"]).assign(k=np.arange(len(x)))
    got = neighbours.knn_graph(spark.createDataFrame(pdf), "k", ["p", "q", "r"], 4, block, pivots).collect()
    z = (x - x.mean(0)) / x.std(0)
    want = brute_neighbours(z, pdf["k"].tolist(), 4)
    found = {}
    for r in sorted(got, key=lambda r: (r["k"], r["rank"])):
        found.setdefault(r["k"], []).append((round(r["dist"], 9), r["nbr"]))
    assert found == want


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "k int, v double")
    got = neighbours.knn_graph(df, "k", ["v"], 15).collect()
    assert sorted((r["k"], r["rank"], r["nbr"]) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]


P = [0.001, 0.02, 0.5, 0.04, 0.02]
ADJUSTED = {
    "bonferroni": [0.005, 0.1, 1.0, 0.2, 0.1],
    "sidak": [1 - (1 - p) ** 5 for p in P],
    "holm": [0.005, 0.08, 0.5, 0.08, 0.08],
    "holm-sidak": [1 - 0.999**5, 1 - 0.98**4, 0.5, 1 - 0.96**2, 1 - 0.98**4],
    "simes-hochberg": [0.005, 0.06, 0.5, 0.08, 0.06],
    "fdr_bh": [0.005, 0.1 / 3, 0.5, 0.05, 0.1 / 3],
    "fdr_by": [min(1, v * (1 + 1 / 2 + 1 / 3 + 1 / 4 + 1 / 5)) for v in [0.005, 0.1 / 3, 0.5, 0.05, 0.1 / 3]],
    "fdr_tsbh": [v / 5 for v in [0.005, 0.1 / 3, 0.5, 0.05, 0.1 / 3]],
    "no such method": P,
}


@pytest.mark.parametrize("method", ADJUSTED)
def test_adjusted_values(spark, method):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(P)] + [(9, None)], "i int, p_value double")
    rows = {r["i"]: r["p_adjusted"] for r in multitest.adjust_pvalues(df, method=method).collect()}
    assert rows[9] is None
    assert [rows[i] for i in range(5)] == pytest.approx(ADJUSTED[method])


def hommel(p):
    """Closed testing with Simes tests over all subsets."""
    from itertools import combinations

    n, out = len(p), []
    for i in range(n):
        worst = 0.0
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for rest in combinations(others, size):
                s = sorted([p[i], *(p[j] for j in rest)])
                worst = max(worst, min(len(s) * v / (k + 1) for k, v in enumerate(s)))
        out.append(min(1.0, worst))
    return out


def test_hommel_is_the_closed_simes_test(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        p = [float(v) for v in rng.random(7) ** 2]
        df = spark.createDataFrame(list(enumerate(p)), "i int, p_value double")
        rows = {r["i"]: r["p_adjusted"] for r in multitest.adjust_pvalues(df, method="hommel").collect()}
        assert [rows[i] for i in range(7)] == pytest.approx(hommel(p))


@pytest.mark.parametrize("method", multitest.METHODS)
def test_adjusted_properties(spark, method):
    rng = np.random.default_rng(1)
    p = [float(v) for v in rng.random(30) ** 3]
    df = spark.createDataFrame([(g, i, v) for g in "ab" for i, v in enumerate(p)], "g string, i int, p_value double")
    rows = multitest.adjust_pvalues(df, method=method, family="g").collect()
    a = {r["i"]: r["p_adjusted"] for r in rows if r["g"] == "a"}
    assert a == {r["i"]: r["p_adjusted"] for r in rows if r["g"] == "b"}
    assert all(0 <= v <= 1 for v in a.values())
    ordered = [a[i] for i in np.argsort(p)]
    assert ordered == sorted(ordered)
    if method not in ("fdr_tsbh", "fdr_tsbky", "fdr_gbs"):  # adaptive methods may go below
        assert all(a[i] >= p[i] - 1e-15 for i in range(30))


def test_other_names_of_corrections(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.004, 0.03, 0.2, 0.6])], "i int, p_value double")
    for alias, method in multitest.ALIASES.items():
        pair = [multitest.adjust_pvalues(df, method=x).orderBy("i").collect() for x in (alias, method)]
        assert pair[0] == pair[1]
    unknown = multitest.adjust_pvalues(df, method="none").collect()
    assert all(r["p_adjusted"] == r["p_value"] and r["corrected"] is False for r in unknown)


def test_rank_correlation_with_any_numeric_target(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=200), rng.integers(0, 5, 200)
    df = spark.createDataFrame([(float(a + b), int(b), None) for a, b in zip(x, y)], "x double, y int, void double")
    frame = pd.DataFrame({"x": x + y, "y": y})
    for method in ("spearman", "kendall"):
        found = {r["feature"]: r["r"] for r in correlation.target_correlations(df, ["x", "void"], "y", method).collect()}
        assert found["void"] is None
        if method == "spearman":
            want = frame["x"].rank().corr(frame["y"].rank())
        else:
            a, b = np.triu_indices(200, 1)
            dx, dy = np.sign(frame["x"].to_numpy()[a] - frame["x"].to_numpy()[b]), np.sign(y[a] - y[b])
            want = (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())
        assert abs(found["x"] - want) < 1e-9
    assert [r["auc"] for r in twoclass.feature_auc(df, ["x"], "y").collect()] == [None]


def test_neighbours_copies_in_many_dimensions(spark, monkeypatch):
    """Where cells leave out nothing a row is copied a bounded number of times, and the neighbours stay exact."""
    monkeypatch.setattr(neighbours, "POOL_SLICE", 40)
    monkeypatch.setattr(neighbours, "QUERY_SLICE", 30)
    sizes = []
    kernel = neighbours._block_neighbours

    def counted(k, id_type):
        tasks = spark.sparkContext.accumulator(0)
        sizes.append(tasks)
        run = kernel(k, id_type)

        def wrapped(group):
            tasks.add(len(group))
            return run(group)

        return wrapped

    monkeypatch.setattr(neighbours, "_block_neighbours", counted)
    rng = np.random.default_rng(8)
    names = [f"v{i}" for i in range(24)]
    pdf = pd.DataFrame(rng.normal(size=(600, 24)), columns=names).assign(k=np.arange(600))
    got = neighbours.knn_graph(spark.createDataFrame(pdf), "k", names, 5, 10, 64).collect()
    x = pdf[names].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    want = brute_neighbours(z, pdf["k"].tolist(), 5)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    best = {(i, r + 1): j for i in range(600) for r, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    assert len(got) == 3000 == len(want) * (3000 // len(want))
    assert all(r["nbr"] == best[r["k"], r["rank"]] for r in got)
    assert sizes[0].value <= 600 * sum(neighbours._grid(600, 10)) < 600 * 64
