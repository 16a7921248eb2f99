"""Exact p-values against enumeration of all rankings, and constants of small cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from classlens.operators import twoclass
from classlens.operators.exact_tests import ks_exact, mannwhitney_exact
from classlens.plans.separation import separation_summary


def rankings(n0, n1):
    u, d = [], []
    for chosen in itertools.combinations(range(n0 + n1), n1):
        signal = np.zeros(n0 + n1)
        signal[list(chosen)] = 1
        u.append(sum(chosen) - n1 * (n1 - 1) // 2)
        d.append(np.abs(np.cumsum(signal) / n1 - np.cumsum(1 - signal) / n0).max())
    return np.array(u), np.array(d)


@pytest.mark.parametrize("n0,n1", [(1, 1), (3, 4), (5, 5), (8, 4), (2, 9), (1, 6)])
def test_all_rankings(n0, n1):
    u, d = rankings(n0, n1)
    for x in set(u.tolist()):
        assert mannwhitney_exact(x, n0, n1) == pytest.approx(min(1.0, 2 * np.mean(u >= max(x, n0 * n1 - x))))
    for x in set(d.round(12).tolist()):
        assert ks_exact(x, n0, n1) == pytest.approx(np.mean(d >= x - 1e-9))


def test_known_values():
    assert mannwhitney_exact(17, 5, 4) == pytest.approx(2 * 7 / 126)  # U of 17 or more: 7 of 126 rankings
    assert mannwhitney_exact(0, 8, 8) == pytest.approx(2 / 12870)
    assert ks_exact(1.0, 6, 6) == pytest.approx(2 / 924) and ks_exact(0.0, 6, 7) == 1.0
    small = ks_exact(1.0, 300, 200)
    assert 0 < small < 1e-140  # the tail keeps its digits


def test_large_second_class():
    """Beyond the tabled sums the polynomial takes over; the normal form is close there."""
    n = 20_000
    for m in (1, 3, 8):
        sigma = np.sqrt(m * n * (m + n + 1) / 12)
        p = mannwhitney_exact(m * n // 2 + int(1.5 * sigma), m, n)
        assert p == pytest.approx(0.1336, abs=0.012 if m > 1 else 0.02)
    assert mannwhitney_exact(20, 1, 20_000) == pytest.approx(2 * 21 / 20_001)


def test_tables(spark):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(round(b)), 1.0, None, int(i < 6)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)) * 3)]
    df = spark.createDataFrame(rows, "free double, tied double, flat double, void double, y int")
    features = ["free", "tied", "flat", "void"]

    def p_of(method, exact):
        return {r["feature"]: r["p_value"] for r in twoclass.feature_separation(df, features, "y", method, exact).collect()}

    x, y = np.array([r[0] for r in rows]), np.array([r[4] for r in rows])
    u = sum((a > x[y == 0]).sum() for a in x[y == 1])
    exact, plain = p_of("mannwhitney", True), p_of("mannwhitney", False)
    assert exact["free"] == pytest.approx(mannwhitney_exact(u, 34, 6)) and exact["free"] != plain["free"]
    assert exact["tied"] == plain["tied"] and exact["void"] is None
    both = [np.searchsorted(np.sort(x[y == c]), np.sort(x), side="right") / (y == c).sum() for c in (0, 1)]
    exact = p_of("ks", True)
    assert exact["free"] == pytest.approx(ks_exact(np.abs(both[0] - both[1]).max(), 34, 6))
    assert exact["flat"] == 1.0 and exact["void"] is None
    for method in ("mannwhitney", "ks"):
        summary = {r["feature"]: r["p_value"] for r in separation_summary(df, ["free", "tied"], "y", method, exact=True).collect()}
        assert summary == {f: p_of(method, True)[f] for f in ("free", "tied")}
