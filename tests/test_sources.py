from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from classlens.operators.fingerprint import fingerprint
from classlens.params import JobParams
from classlens.plans.registry import QUERIES
from classlens.sources import readers, sinks
from classlens.sources.workdir import job_scope, shared_folder, stage


@pytest.fixture()
def csv_file(tmp_path):
    path = tmp_path / "data.csv"
    lines = ["p,q"] + [f"{i},{i * 0.5}" for i in range(10)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_load_features(spark, csv_file):
    params = JobParams(n_features=2, number_of_signals=4)
    rows = readers.load_features(spark, csv_file, params).orderBy("row_number").collect()
    assert [r["signal"] for r in rows] == [1] * 4 + [0] * 6
    assert [r["feature_1"] for r in rows] == [i * 0.5 for i in range(10)]
    assert rows[0].asDict().keys() == {"feature_0", "feature_1", "row_number", "signal"}


def test_row_numbers_follow_the_blocks_of_a_large_file(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(50000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 5
        numbered = readers.with_row_number(df, "n")
        assert numbered.where("v <> n").count() == 0 and numbered.count() == 50000
        for n in (0, 1, 20000, 49999, 50000, 60000):
            labelled = readers.label_first_rows(df, n)
            assert labelled.where(f"(v < {n}) <> (signal = 1)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_over_several_parquet_files(spark):
    path = shared_folder(spark, "rows-test")
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    numbered = readers.with_row_number(spark.read.parquet(path), "n")
    assert numbered.where("id <> n").count() == 0
    labelled = readers.label_first_rows(spark.read.parquet(path), 333)
    assert labelled.where("(id < 333) <> (signal = 1)").count() == 0


def test_label_by_an_index_column(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    assert readers.label_first_rows(df, 3, "signal", "n").where("signal = 1").count() == 3


def test_errors(spark, csv_file, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        readers.read_parquet(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="expected 50 columns, got 2"):
        readers.read_csv(spark, csv_file, 50)


def test_rename_and_expand(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "a int, v array<double>")
    assert readers.rename_features(df).columns == ["feature_0", "feature_1"]
    assert readers.expand_vector(df, "v", 2, ["a"]).first() == (1, 1.0, 2.0)


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "x|y", "z")], "i int, s string, t string")
    base = fingerprint(df).first()["fingerprint"]
    assert fingerprint(df.repartition(3)).first()["fingerprint"] == base
    moved = df.select("i", F.col("t").alias("s"), F.col("s").alias("t"))
    assert fingerprint(moved).first()["fingerprint"] != base
    joined = df.withColumn("s", F.when(F.col("i") == 3, "x").otherwise(F.col("s"))).withColumn(
        "t", F.when(F.col("i") == 3, "y|z").otherwise(F.col("t"))
    )
    assert fingerprint(joined).first()["fingerprint"] != base
    twice = df.unionByName(df)
    assert fingerprint(twice).first()["fingerprint"] != base
    ordered = fingerprint(df.withColumn("n", F.col("i")), ["s", "t"], "n").first()["fingerprint"]
    swapped = fingerprint(df.withColumn("n", 4 - F.col("i")), ["s", "t"], "n").first()["fingerprint"]
    assert ordered != swapped


def test_splits_csv(spark):
    df = spark.createDataFrame([("a", 0, 0.1, "train"), ("b", 1, 1e-300, "test")], "k string, y int, v double, split string")
    path = sinks.write_splits_csv(df, shared_folder(spark, "csv-test"))
    assert sorted(sinks.read_splits_csv(spark, path, df.schema).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        sinks.write_splits_csv(df.drop("split"), path)


def test_lineage_and_summary(spark):
    df = spark.range(5)
    row = sinks.lineage(df, "somewhere", pipeline_exported=False, clean=True)
    path = sinks.write_lineage(row, shared_folder(spark, "lineage-test"))
    text = spark.read.text(path).first()[0]
    facts = json.loads(text)
    assert facts["data_path"] == "somewhere" and facts["n_rows"] == 5
    assert facts["facts"] == {"clean": "True", "pipeline_exported": "False"}
    summary = sinks.write_summary_csv(df, shared_folder(spark, "summary-test"))
    assert spark.read.csv(summary, header=True).count() == 5


def test_stage_keeps_the_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") / 3)
    staged = stage(df)
    assert sorted(staged.collect()) == sorted(df.collect())
    assert staged.inputFiles()


def test_shared_folder_is_below_the_configured_one(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first != second
    if base:
        assert first.startswith(base.rstrip("/"))


def test_row_numbers_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    path = tmp_path / "cut.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(60000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        df = readers.read_csv(spark, str(path))
        numbered = readers.with_row_number(df, "n")
        labelled = readers.label_first_rows(df, 20001)
        for size, least in (("200000", "3"), ("9000", "20")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.minPartitionNum", least)
            assert numbered.count() == 60000 and numbered.where("v <> n").count() == 0
            assert labelled.where("(v < 20001) <> (signal = 1)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_job_scope_deletes_what_was_staged(spark):
    import os
    from urllib.parse import urlsplit

    with job_scope(spark):
        staged = stage(spark.range(5))
        folder = os.path.dirname(urlsplit(staged.inputFiles()[0]).path)
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("column", ["l_extendedprice", "l_quantity", "l_shipdate", "l_linestatus"])
def test_registered_hashes_cover_every_column(spark, tmp_path, column):
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50).coalesce(1)
    other = {"l_shipdate": F.expr("l_shipdate + INTERVAL 1 DAY"), "l_linestatus": F.concat("l_linestatus", F.lit("x"))}
    changed = source.withColumn(column, other.get(column, F.col(column) + 1))
    for name, df in (("a", source), ("b", changed)):
        df.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    for query, value in (
        ("dataset_fingerprint_all", "fingerprint"),
        ("dataset_fingerprint_ordered_all", "fingerprint"),
        ("lineage_all", "data_hash"),
    ):
        a, b = (QUERIES[query](spark, f"{tmp_path}/{x}").first()[value] for x in "ab")
        assert a != b
