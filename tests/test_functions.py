from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from classlens.functions import numeric, tails
from classlens.operators.resampling import beta_tail, order_rank


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_normal_tail(spark):
    z = [0.0, 0.1, -0.5, 1.0, 1.96, 2.8, 2.83, -3.0, 5.0, 9.0, 20.0, 37.0]
    for value, got in zip(z, column(spark, z, tails.normal_two_sided)):
        assert got == pytest.approx(math.erfc(abs(value) / math.sqrt(2)), rel=1e-12)


def test_normal_tail_of_null(spark):
    assert column(spark, [None], tails.normal_two_sided) == [None]


def test_kolmogorov_tail(spark):
    lam = [0.0, 0.3, 0.7, 0.999, 1.0, 1.2238, 1.3581, 1.6276, 3.0]

    def exact(x):
        return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200))

    got = column(spark, lam, tails.kolmogorov_tail)
    assert got[0] == 1.0
    for value, p in zip(lam[1:], got[1:]):
        assert p == pytest.approx(exact(value), abs=1e-9)
    assert got[5] == pytest.approx(0.10, abs=1e-3)
    assert got[6] == pytest.approx(0.05, abs=1e-3)


def test_log_gamma(spark):
    x = [0.5, 1.0, 1.5, 2.0, 7.25, 50.0, 400.5]
    for value, got in zip(x, column(spark, x, tails.log_gamma)):
        assert got == pytest.approx(math.lgamma(value), abs=1e-11)


def student_by_integration(t, df, steps=40000):
    front = math.exp(
        math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    )
    h = abs(t) / steps
    total = 0.0
    for j in range(steps + 1):
        w = 1 if j in (0, steps) else (4 if j % 2 else 2)
        total += w * front * (1 + (j * h) ** 2 / df) ** (-(df + 1) / 2)
    return 1 - 2 * total * h / 3


@pytest.mark.parametrize("df", [1.0, 2.5, 10.0, 137.3, 400.0, 401.0, 5000.0, 1e6])
def test_student_tail(spark, df):
    ts = [0.0, 0.2, -1.0, 2.0, 4.0]
    got = column(spark, ts, lambda t: tails.student_two_sided(t, F.lit(df)))
    for t, p in zip(ts, got):
        assert p == pytest.approx(student_by_integration(t, df), abs=2e-9)


def test_student_tail_known_values(spark):
    # two-sided 5 % points of Student's t
    for df, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423)):
        got = column(spark, [t], lambda x: tails.student_two_sided(x, F.lit(float(df))))
        assert got[0] == pytest.approx(0.05, abs=1e-5)


def test_skewness(spark):
    def skew(values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return df.agg(numeric.sample_skewness(F.col("x"))).first()[0]

    assert skew([1.0, 2.0, 4.0, 10.0]) == pytest.approx(1.4693, abs=1e-4)
    assert skew([3.0, 3.0, 3.0]) == 0.0
    assert skew([1.0, 2.0]) is None


def test_clean_double(spark):
    assert column(spark, [1.0, float("nan"), None], numeric.clean_double) == [1.0, None, None]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 400), st.integers(1, 400), st.floats(0.01, 0.99))
def test_beta_tail_is_binomial(n, k, x):
    k = min(k, n)
    direct = sum(
        math.exp(
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(x) + (n - i) * math.log1p(-x)
        )
        for i in range(k, n + 1)
    )
    assert beta_tail(x, k, n - k + 1) == pytest.approx(direct, abs=1e-9)


def test_order_rank_brackets_the_median():
    assert order_rank(1, 1, 0.5) == 0
    low, high = order_rank(1001, 501, 0.025), order_rank(1001, 501, 0.975)
    assert low < 500 < high
    assert abs((high - low) - 2 * 1.96 * math.sqrt(1001) / 2) < 3
