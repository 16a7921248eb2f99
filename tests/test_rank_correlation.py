"""Rank correlations by class and null pattern, against pandas on each pair's own rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from classlens.operators import correlation, multitest, rank_correlation


def tau_b(x, y):
    s = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])
    nx, ny = (x[:, None] != x[None, :]).sum(), (y[:, None] != y[None, :]).sum()
    return s.sum() / np.sqrt(float(nx) * float(ny)) if nx and ny else None


def rho(x, y):
    x, y = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    return np.corrcoef(x, y)[0, 1] if len(x) > 1 and x.std() > 0 and y.std() > 0 else None


HOW = {"spearman": rho, "kendall": tau_b}


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(21)
    n = 400
    base = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "class": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])})
    pdf.loc[rng.random(n) < 0.05, "class"] = None
    for i in range(12):
        x = base * rng.normal() + rng.normal(size=n)
        pdf[f"f.{i}"] = np.round(x, 1) if i % 3 == 0 else x
        if i % 4:
            pdf.loc[pdf.index % (3 + i % 4) == 0, f"f.{i}"] = np.nan
    pdf["hot"] = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))
    pdf["flat"], pdf["void"] = 0.1, np.nan
    return spark.createDataFrame(pdf.astype({"class": object}).where(pdf.notna(), None), "id long, class string, " + ", ".join(
        f"`{c}` double" for c in pdf.columns[2:])).cache(), pdf


def columns_of(pdf):
    return list(pdf.columns[2:])


def compare(found, pdf, columns, method, against=None, group=False):
    seen = 0
    for r in found.collect():
        part = pdf[pdf["class"] == r["class"]] if group else pdf
        both = part[[r["col_a"], r["col_b"]]].dropna().to_numpy()
        assert r["n"] == len(both)
        want = HOW[method](both[:, 0], both[:, 1]) if len(both) else None
        assert r["r"] == (want if want is None else pytest.approx(want, abs=1e-9)), (r, want)
        assert against is None or r["col_b"] == against
        seen += 1
    return seen


@pytest.mark.parametrize("partitions", ["8", "40"])
@pytest.mark.parametrize("group", [None, "class"])
@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_pairs(spark, holes, method, group, partitions):
    df, pdf = holes
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        columns = columns_of(pdf) if partitions == "8" else ["f.0", "f.5", "flat", "hot"]
        found = correlation.correlation_pairs(df, columns, method, "id", group)
        seen = compare(found, pdf, columns, method, group=bool(group))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    pairs = len(columns) * (len(columns) - 1) // 2 * (3 if group else 1)
    if method == "spearman":
        assert seen == pairs
    else:  # pairs without a common row have no row
        assert seen == sum(len(columns_of(pdf)) - 1 and 1 for _ in range(seen)) <= pairs


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_against_one_column(holes, method):
    df, pdf = holes
    columns = ["f.1", "hot", "f.6", "f.2"]
    how = rank_correlation.spearman_pairs if method == "spearman" else rank_correlation.kendall_pairs
    assert compare(how(df, columns, "id", against="hot"), pdf, columns, method, "hot") == 3
    assert compare(how(df, columns, "id", "class", "hot"), pdf, columns, method, "hot", True) == 9


def test_patterns_and_scans(spark, tmp_path):
    """64 columns with nulls: ranks per null pattern, and three reads of the input."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({f"x{i}": np.round(rng.normal(size=150), 2) for i in range(64)}).assign(id=np.arange(150))
    for i in range(64):
        if i % 5:
            pdf.loc[pdf.index % (4 + i % 5) == 1, f"x{i}"] = np.nan
    spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns[:-1]) + ", id long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    columns = list(pdf.columns[:-1])
    ranks = rank_correlation._Ranks(df, columns, "id", None, None)
    assert len(ranks.present) == 5
    assert ranks._row_by_row is not None and all(len(s) == 5 for s in ranks.slots)
    from py4j.java_gateway import JavaObject  # noqa: F401

    found = rank_correlation.spearman_pairs(df, columns, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("x0#") and plan.count("Relation [x0#") == 1  # survey and counts have run; this is the third read
    pdf["class"] = "a"
    assert compare(found, pdf, columns, "spearman") == 64 * 63 // 2


def test_no_rows_and_names(spark, holes):
    df, _ = holes
    for how in (rank_correlation.spearman_pairs, rank_correlation.kendall_pairs):
        assert how(df.limit(0), ["f.0", "hot"], "id").collect() == []
        with pytest.raises(ValueError):
            how(df, ["hot", "hot"], "id")


def test_top_correlations_inside_classes(holes):
    df, pdf = holes
    features = ["f.3", "f.6", "flat", "hot"]
    plain = df.select("id", "class", F.col("`f.0`").alias("t"), *[F.col(f"`{f}`").alias(f.replace(".", "")) for f in features])
    names = [f.replace(".", "") for f in features]
    values = pdf.rename(columns={"f.0": "t"} | dict(zip(features, names)))
    for method in correlation.METHODS:
        rows = correlation.top_correlations(plain, names, "t", 2, method, per_class="class").collect()
        for c in "abc":
            part = values[values["class"] == c]
            if method == "pearson":
                want = {f: part[[f, "t"]].dropna().corr().iloc[0, 1] for f in names if f != "flat"}
            else:
                want = {f: HOW[method](*part[[f, "t"]].dropna().to_numpy().T) for f in names if f != "flat"}
            best = sorted(want, key=lambda f: -abs(want[f]))[:2]
            assert {r["feature"]: r["r"] for r in rows if r["class"] == c} == {f: pytest.approx(want[f], abs=1e-9) for f in best}
        matrix = correlation.correlation_submatrix(plain, names, "t", 2, method, "id", per_class="class").collect()
        assert len(matrix) == 27
        top = {(r["class"], r["feature"]): r["r"] for r in rows}
        for r in matrix:
            if r["col_b"] == "t" and r["col_a"] != "t":
                assert r["r"] == pytest.approx(top[r["class"], r["col_a"]])
            if r["col_a"] == r["col_b"]:
                assert r["r"] == 1.0


def test_classes_of_the_target(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)), columns=["p", "q", "s"]).assign(k=range(60), y=[0, 1] * 30, c=1.0)
    df = spark.createDataFrame(pdf)
    rows = correlation.top_correlations(df, ["q", "p", "s"], "y", 2, "kendall", per_class=True).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "p", None), (0, "q", None), (1, "p", None), (1, "q", None)]
    assert correlation.top_correlations(df, ["q", "p"], "y", 2, positive_only=True, per_class=True).collect() == []
    for method in correlation.METHODS:
        cells = correlation.correlation_submatrix(df, ["q", "p", "c", "s"], "y", 3, method, "k", per_class=True).collect()
        got = {(r["class"], r["col_a"], r["col_b"]): r["r"] for r in cells}
        assert len(got) == len(cells) == 32
        part = pdf[pdf["y"] == 1]
        want = np.corrcoef(part["q"], part["p"])[0, 1] if method == "pearson" else HOW[method](part["q"].to_numpy(), part["p"].to_numpy())
        assert got[1, "q", "p"] == got[1, "p", "q"] == pytest.approx(want)
        assert got[1, "q", "y"] is None and got[0, "c", "p"] is None and got[0, "p", "p"] == 1.0
        assert got[0, "y", "y"] == (1.0 if method == "kendall" else None)
        lone = correlation.correlation_submatrix(df, ["q"], "y", 3, method, "k", negative_only=True, per_class=True).collect()
        assert [(r["col_a"], r["col_b"]) for r in lone] == [("y", "y")] * 2
    with pytest.raises(ValueError):
        correlation.top_correlations(df, ["q"], "y", per_class="none")


def slow_hommel(p):
    order = np.argsort(p, kind="stable")
    v, n = p[order], len(p)
    a = v.copy()
    for m in range(n, 1, -1):
        least = np.min(m * v[-m:] / np.arange(1, m + 1.0))
        a[-m:] = np.maximum(a[-m:], least)
        a[:-m] = np.maximum(a[:-m], np.minimum(m * v[:-m], least))
    out = np.empty(n)
    out[order] = np.minimum(a, 1)
    return out


def test_hommel_in_log_linear_time():
    rng = np.random.default_rng(0)
    for k in range(500):
        p = rng.random(rng.integers(1, 60)) ** rng.choice([1, 3, 8])
        p = np.round(p, 1) if k % 3 == 0 else p
        assert multitest.hommel(p) == pytest.approx(slow_hommel(p), abs=1e-13)
    p = rng.random(5000) ** 3
    assert multitest.hommel(p) == pytest.approx(slow_hommel(p), abs=1e-13)


def test_hommel_families_and_nulls(spark):
    rng = np.random.default_rng(1)
    p = rng.random(3000) ** 2
    rows = [("x", i, float(v)) for i, v in enumerate(p)] + [(None, 1, 0.01), (None, 2, 0.02), ("z", 3, None), ("x", -1, None)]
    df = spark.createDataFrame(rows, "g string, i int, p double")
    found = multitest.adjust_pvalues(df, "p", "hommel", "g")
    got = {(r["g"], r["i"]): r["p_adjusted"] for r in found.collect()}
    assert [got["x", i] for i in range(3000)] == pytest.approx(slow_hommel(p))
    assert got["z", 3] is None and got["x", -1] is None and [got[None, 1], got[None, 2]] == pytest.approx([0.02, 0.02])
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert multitest.adjust_pvalues(df.limit(0), "p", "hommel").collect() == []


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_few_values_need_no_rank_of_a_row(spark, monkeypatch, method):
    """Pairs with a side of few values are counted, over several stretches; rows are not ranked and looked up."""
    monkeypatch.setattr(rank_correlation, "_Ranks", None)
    monkeypatch.setattr(rank_correlation, "STRETCH_ROWS", 40)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(600), "class": rng.choice(["a", "b"], 600)})
    pdf["x"] = np.where(rng.random(600) < 0.3, -0.0, rng.normal(size=600))
    pdf["s"] = np.round(pdf["x"] + rng.normal(size=600))
    pdf["t"] = np.where(rng.random(600) < 0.1, np.nan, rng.integers(0, 9, 600) - pdf["s"])
    pdf["flat"] = 3.0
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype({"class": object}).where(pdf.notna(), None), "id long, class string, x double, s double, t double, flat double")
    columns = ["x", "s", "t", "flat"]
    for group in (None, "class"):
        found = correlation.correlation_pairs(df, columns, method, "id", group)
        assert compare(found, pdf, columns, method, group=bool(group)) == 6 * (2 if group else 1)


def test_matrix_inside_classes_ranks_once(holes, monkeypatch):
    """The top features of a class are read from the pairs of the matrix."""
    df, pdf = holes
    monkeypatch.setattr(correlation, "target_correlations", None)
    plain = df.select("id", "class", F.col("`f.0`").alias("t"), F.col("`f.3`").alias("f3"), "flat", "hot")
    rows = correlation.correlation_submatrix(plain, ["f3", "flat", "hot"], "t", 2, "spearman", "id", per_class="class").collect()
    for name in "abc":
        part = pdf[pdf["class"] == name].rename(columns={"f.3": "f3", "f.0": "t"})
        got = {(r["col_a"], r["col_b"]): r["r"] for r in rows if r["class"] == name}
        assert {a for a, _ in got} == {"f3", "hot", "t"} and len(got) == 9
        both = part[["f3", "t"]].dropna().to_numpy()
        assert got["f3", "t"] == got["t", "f3"] == pytest.approx(rho(both[:, 0], both[:, 1]), abs=1e-9)
