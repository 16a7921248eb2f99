from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from classlens.operators import preparation as prep
from classlens.operators import splitting
from classlens.params import JobParams
from classlens.plans.process import process, process_cached, select_split
from classlens.sources import sinks
from classlens.sources.workdir import shared_folder
from classlens.streaming import transform as streaming


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(3, 2, 400), rng.exponential(1, 400)
    b[7] = 90.0
    rows = [(f"r{i}", int(i % 10 < 3), float(a[i]), float(b[i]), 1.5) for i in range(400)]
    return spark.createDataFrame(rows, "k string, y int, a double, b double, flat double").cache(), a, b


def test_prepare_features(spark, table):
    df, _, _ = table
    out = prep.prepare_features(df.withColumn("y", F.col("y").cast("double")), "y", "k")
    assert dict(out.dtypes)["y"] == "int" and out.columns[:2] == ["k", "y"]
    with pytest.raises(ValueError):
        prep.prepare_features(df, "nope")


@pytest.mark.parametrize("method", ["standard", "robust"])
def test_fit_and_apply(table, method):
    df, a, b = table
    params = prep.fit(df, ["a", "b", "flat"], method)
    rows = {r["feature"]: r for r in params.collect()}
    assert [rows[f]["kept"] for f in ("a", "b", "flat")] == [True, True, False]
    assert rows["flat"]["scale"] == 1.0 and rows["flat"]["variance"] == 0.0
    out = prep.apply(df, params, ["k"]).toPandas().set_index("k")
    assert list(out.columns) == ["a", "b"]
    for name, x in (("a", a), ("b", b)):
        if method == "standard":
            want = (x - x.mean()) / x.std()
        else:
            q1, q2, q3 = np.percentile(x, [25, 50, 75])
            want = (x - q2) / (q3 - q1)
        assert out.loc["r5", name] == pytest.approx(want[5])


def test_apply_never_refits(table):
    df, a, _ = table
    params = prep.fit(df, ["a"])
    one = prep.apply(df.where("k = 'r3'"), params).first()
    assert one["a"] == pytest.approx((a[3] - a.mean()) / a.std())
    with pytest.raises(ValueError):
        prep.apply(df.drop("a"), params)


def test_nothing_kept_is_an_error(table):
    df, _, _ = table
    with pytest.raises(ValueError):
        prep.apply(df, prep.fit(df, ["flat"]))
    with pytest.raises(ValueError):
        prep.fit(df, ["a"], "power")


def test_threshold_zero_uses_the_range(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 3.0)], "c double, v double")
    kept = {r["feature"]: r["kept"] for r in prep.fit(df, ["c", "v"], variance_threshold=0).collect()}
    assert kept == {"c": False, "v": True}


def test_outlier_flag(table):
    df, _, _ = table
    params = prep.fit(df, ["a", "b", "flat"], "robust")
    flagged = prep.apply(df, params, ["k"], 4.0).where("is_outlier = 1").select("k").collect()
    assert "r7" in {r["k"] for r in flagged} and len(flagged) < 10


def quotas(counts, test_size):
    """Largest remainder, computed with fractions."""
    total = sum(counts.values())
    draws = math.ceil(test_size * total)
    floors = {c: n * draws // total for c, n in counts.items()}
    rest = sorted(counts, key=lambda c: (-(counts[c] * draws % total), c))
    for c in rest[: draws - sum(floors.values())]:
        floors[c] += 1
    return floors


@pytest.mark.parametrize("n,size", [(400, 0.2), (397, 0.3), (23, 0.1), (7, 0.25)])
def test_split_sizes(table, n, size):
    df, _, _ = table
    part = df.where(F.substring("k", 2, 9).cast("int") < n)
    split = splitting.stratified_split(part, "k", "y", size, 1)
    got = {r["y"]: r["count"] for r in split.where("split = 'test'").groupBy("y").count().collect()}
    counts = {r["y"]: r["count"] for r in part.groupBy("y").count().collect()}
    want = {c: q for c, q in quotas(counts, size).items() if q}
    assert got == want
    assert split.count() == n


def test_split_depends_on_the_seed_only(table):
    df, _, _ = table
    def test_rows(d, seed):
        return {r["k"] for r in splitting.stratified_split(d, "k", "y", 0.2, seed).where("split = 'test'").collect()}
    assert test_rows(df, 3) == test_rows(df.repartition(5), 3) != test_rows(df, 4)


def test_split_rejects_a_single_row_class(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "k string, y int")
    with pytest.raises(Exception, match="at least 2 rows"):
        splitting.stratified_split(df, "k", "y").collect()


def test_process(table):
    df, _, _ = table
    splits, fitted = process(df, JobParams(target="y"), "k")
    assert splits.columns == ["k", "split", "y", "a", "b", "is_outlier"]
    assert splits.count() == 400 and splits.where("split = 'test'").count() == 80
    test = select_split(splits, "test", as_vector=True)
    assert dict(test.dtypes)["features"] == "array<double>" and test.count() == 80
    without_key, _ = process(df.drop("k"), JobParams(target="y", add_outlier_flag=False))
    assert without_key.columns == ["row_key", "split", "y", "a", "b"]


def test_fit_on_train_differs(table):
    df, _, _ = table
    _, everything = process(df, JobParams(target="y"), "k")
    _, train = process(df, JobParams(target="y"), "k", fit_on="train")
    assert everything.where("feature = 'a'").first()["center"] != train.where("feature = 'a'").first()["center"]
    with pytest.raises(ValueError):
        process(df, JobParams(target="y"), "k", fit_on="test")


def test_cache(spark, table):
    df, _, _ = table
    params, base = JobParams(target="y"), shared_folder(spark, "cache-test")
    key = sinks.cache_key(df, params)
    assert sinks.load_from_cache(spark, base, key) is None
    first, fitted = process_cached(df, params, base, "k")
    again, _ = process_cached(df, params, base, "k")
    assert first.count() == again.count() == 400 and fitted.count() == 3
    changed = df.withColumn("b", F.when(F.col("k") == "r399", 0.0).otherwise(F.col("b")))
    assert sinks.cache_key(changed, params) != key
    assert sinks.cache_key(df, params.with_changes(seed=1)) != key


def test_cache_knows_every_argument(spark, table):
    """Results of other arguments are not taken for those asked for, and a half-written entry is none."""
    df, _, _ = table
    params, base = JobParams(target="y"), shared_folder(spark, "cache-arguments")
    doubled = df.drop("k").unionByName(df.drop("k").limit(40))
    cleaned, _ = process_cached(doubled, params, base)
    kept, _ = process_cached(doubled, params, base, clean_first=False)
    assert kept.count() == doubled.count() > cleaned.count()
    _, everything = process_cached(df, params, base, "k")
    _, train = process_cached(df, params, base, "k", fit_on="train")
    assert everything.where("feature = 'a'").first()["center"] != train.where("feature = 'a'").first()["center"]
    entry = sinks.cache_key(df, params, key="k", clean_first=True, fit_on="all")
    assert sinks.load_from_cache(spark, base, entry) is not None
    metadata = spark.read.json(f"{base}/processed_{entry}/metadata").first()
    fitted = sinks.load_from_cache(spark, base, entry)[1]
    assert sorted(json.loads(metadata["features"])) == sorted(r["feature"] for r in fitted.where("kept").collect())
    spark.createDataFrame([], "created_at string").write.mode("overwrite").json(f"{base}/processed_{entry}/metadata")
    assert sinks.load_from_cache(spark, base, entry) is None


def test_params_roundtrip(spark, table):
    df, _, _ = table
    path = shared_folder(spark, "params-test")
    fitted = prep.fit(df, ["a", "b"])
    loaded = sinks.read_params(spark, sinks.write_params(fitted, path))
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, fitted.collect()))
    with pytest.raises(FileNotFoundError):
        sinks.read_params(spark, path + "-missing")


def test_stream_gives_the_batch_result(spark, table):
    df, _, _ = table
    base = shared_folder(spark, "stream-test")
    df.repartition(4).write.parquet(f"{base}/in")
    params = prep.fit(df, ["a", "b"])
    stream = streaming.read_stream(spark, f"{base}/in", df.schema)
    assert stream.isStreaming
    scaled = streaming.transform_stream(stream, params, ["k"], 4.0)
    streaming.write_available(scaled, f"{base}/out", f"{base}/checkpoint")
    streaming.write_available(scaled, f"{base}/out", f"{base}/checkpoint")
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()))
    assert got == sorted(map(tuple, prep.apply(df, params, ["k"], 4.0).collect()))


def test_params_bounds():
    JobParams()
    for bad in (
        {"test_size": 0.05}, {"test_size": 0.35}, {"val_size": 0.4}, {"test_size": 0.3, "val_size": 0.3},
        {"seed": -1}, {"variance_threshold": -1e-9}, {"number_of_signals": -1},
        {"number_of_background": -1}, {"scale_method": "power"}, {"target": ""}, {"n_features": 0},
    ):
        with pytest.raises(ValueError):
            JobParams(**bad)
        with pytest.raises(ValueError):
            JobParams().with_changes(**bad)
    with pytest.raises(AttributeError):
        JobParams().seed = 3


def test_split_of_many_classes_and_null_classes(spark):
    df = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") % 1500).alias("y"))
    counts = splitting.stratified_split(df, "k", "y", 0.25, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"test": 2250, "train": 6750}
    missing = df.where("k < 20").withColumn("y", F.when(F.col("k") > 3, F.col("k") % 2))
    with pytest.raises(Exception, match="is null in some rows"):
        splitting.stratified_split(missing, "k", "y", 0.25, 1).collect()


def test_quota_holds_without_a_key(spark):
    rows = [(float(i % 40), -999.0 if i % 3 else 1.0 * (i // 40), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, b double, signal int")
    for clean_first in (True, False):
        params = JobParams(n_features=2, test_size=0.15)
        splits, _ = process(df, params, clean_first=clean_first)
        n = splits.count()
        assert splits.select("row_key").distinct().count() == n
        assert splits.where("split = 'test'").count() == -(-n * 15 // 100)
