from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from classlens.operators import cleaning, profiling
from classlens.operators.longform import validate_frame
from classlens.plans.process import clean

NAN = float("nan")


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, 1.0, -999.0, None, "a"),
        (1, 1.0, -999.0, None, "a"),
        (0, NAN, 4.0, None, "b"),
        (0, 3.0, 6.0, None, None),
        (-999, 8.0, 8.0, None, "c"),
    ]
    return spark.createDataFrame(rows, "signal int, x double, y double, void double, name string")


def test_dedupe(spark, raw):
    assert cleaning.dedupe(raw).count() == 4
    keyed = raw.selectExpr("*", "uuid() AS k")
    kept = cleaning.dedupe(keyed, "k")
    assert kept.count() == 4 and kept.columns == keyed.columns
    zeros = spark.createDataFrame([(0.0, None), (-0.0, None), (NAN, 1.0), (NAN, 1.0)], "a double, b double")
    assert cleaning.dedupe(zeros).count() == 2


def test_sentinel(raw):
    counts = {r[0]: r[1] for r in cleaning.sentinel_counts(raw).collect()}
    assert counts == {"signal": 1, "x": 0, "y": 2, "void": 0}
    features = cleaning.sentinel_to_null(raw, -999, ["x", "y"])
    assert features.where("y IS NULL").count() == 2
    assert features.where("signal = -999").count() == 1
    assert cleaning.sentinel_to_null(raw).where("signal IS NULL").count() == 1


def test_missing_summary(raw):
    found = {r[0]: r[1] for r in cleaning.missing_summary(raw).collect()}
    assert found == {"signal": 0, "x": 1, "y": 0, "void": 5, "name": 1}


def test_median_impute_and_fallback(raw):
    filled = cleaning.median_impute(cleaning.sentinel_to_null(raw, -999, ["y"]), ["x", "y", "void"])
    rows = filled.collect()
    assert sorted(r["x"] for r in rows) == [1.0, 1.0, 2.0, 3.0, 8.0]
    assert sorted(r["y"] for r in rows) == [4.0, 6.0, 6.0, 6.0, 8.0]
    assert {r["void"] for r in rows} == {4.0}  # median of the medians 2 and 6
    assert filled.where("name IS NULL").count() == 1


def test_all_columns_empty_give_zero(spark):
    empty = spark.createDataFrame([(None,), (None,)], "v double")
    assert [r[0] for r in cleaning.median_impute(empty).collect()] == [0.0, 0.0]


def test_clean_dedupes_before_the_sentinel(spark):
    df = spark.createDataFrame([(0, -999.0), (0, None), (0, None), (1, 5.0)], "signal int, v double")
    cleaned = clean(df, "signal")
    assert cleaned.count() == 3
    assert {r["v"] for r in cleaned.collect()} == {5.0}


def test_clean_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"signal": rng.integers(0, 2, 300), "a": rng.integers(0, 5, 300) * 1.0, "b": rng.normal(size=300)})
    pdf.loc[::9, "a"] = -999.0
    pdf.loc[::13, "b"] = np.nan
    pdf = pd.concat([pdf, pdf.head(40)])
    want = pdf.drop_duplicates().replace(-999, np.nan)
    want = want.fillna(want.median())
    got = clean(spark.createDataFrame(pdf), "signal").toPandas()
    order = ["signal", "a", "b"]
    pd.testing.assert_frame_equal(
        got.sort_values(order, ignore_index=True)[order],
        want.sort_values(order, ignore_index=True)[order],
        check_dtype=False,
    )


PROFILES = {
    "one_value": ([4.0], "linear"),
    "wide_positive": ([1.0, 2000.0, 5.0], "log"),
    "skewed_positive": ([1.0] * 40 + [100.0], "log"),
    "plain_positive": ([1.0, 2.0, 3.0], "linear"),
    "zero_and_one_positive": ([0.0, 0.0, 5.0], "linear"),
    "zeros": ([0.0, 0.0], "linear"),
    "mixed_huge": ([-1.0, 1e-3, 5e6], "symlog"),
    "mixed_large": ([-1.0, 1.0, 2e4], "asinh"),
    "mixed_plain": ([-1.0, 1.0, 9e3], "linear"),
    "wide_negative": ([-1.0, -5000.0], "symlog"),
    "plain_negative": ([-1.0, -2.0], "linear"),
}


@pytest.mark.parametrize("name", PROFILES)
def test_recommended_scale(spark, name):
    values, scale = PROFILES[name]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = profiling.profile_features(df, ["v"]).first()
    assert row["recommended_scale"] == scale
    nonzero = [abs(v) for v in values if v]
    reach = max(map(abs, values)) / min(nonzero) if nonzero else 1.0
    assert row["dynamic_range"] == pytest.approx(reach)
    assert row["span_zero"] == (min(values) <= 0 <= max(values))
    skew = pd.Series(values).skew()
    assert row["skewness"] is None if np.isnan(skew) else row["skewness"] == pytest.approx(skew)


def test_empty_feature_has_no_profile(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert [r["feature"] for r in profiling.profile_features(df, ["a", "b"]).collect()] == ["a"]


def test_scaling_summary(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0, 4.0), (2e3, 2.0, 3.0, 4.0, 5.0)], "e double, d double, c double, b double, a double")
    found = profiling.scaling_summary(profiling.profile_features(df, list("edcba"))).collect()
    by_scale = {r["recommended_scale"]: r for r in found}
    assert by_scale["log"]["n_features"] == 1
    assert [x["feature"] for x in by_scale["linear"]["examples"]] == ["d", "c", "b"]


def test_data_summary(raw):
    row = profiling.data_summary(raw, "signal").first()
    assert (row["total_samples"], row["signal_count"], row["background_count"]) == (5, 2, 2)
    assert row["signal_ratio"] == pytest.approx(0.4)
    assert row["feature_count"] == 4 and row["missing_values"] == 7


def test_class_count_check(raw):
    found = {r["label"]: r for r in profiling.class_count_check(raw, "signal", 2, 3).collect()}
    assert found[1]["matches"] and not found[0]["matches"] and found[0]["n"] == 2


def test_basic_stats(raw):
    found = {r["feature"]: r for r in profiling.basic_stats(raw, ["x", "void"]).collect()}
    assert found["x"]["n"] == 5 and found["x"]["mean"] == pytest.approx(3.25)
    assert found["void"]["n"] == 5 and found["void"]["mean"] is None


def test_validate_frame(spark, raw):
    validate_frame(raw, ["x"])
    with pytest.raises(TypeError):
        validate_frame(pd.DataFrame({"x": [1]}))
    with pytest.raises(ValueError, match="missing"):
        validate_frame(raw, ["nope"])
    with pytest.raises(ValueError, match="empty"):
        validate_frame(raw.limit(0))
