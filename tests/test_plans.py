"""Physical plans: what is scanned, shuffled and reused."""

from __future__ import annotations

import pytest

from classlens.operators import preparation, ranked, splitting, twoclass
from classlens.operators.histogram import class_histogram
from classlens.params import JobParams
from classlens.plans import process as process_plan
from classlens.plans.inputs import FEATURES, items
from classlens.plans.separation import separation_summary
from classlens.sources.readers import label_first_rows

SF_DIR = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def table(spark):
    return items(spark, SF_DIR)


def test_ranking_scans_and_counts_once(table):
    plan = final_plan(ranked.rank_statistics(ranked.ranked_values(table, FEATURES, "y")))
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") >= 1
    assert "SortMergeJoin" not in plan


def test_only_needed_columns_are_read(table):
    plan = final_plan(twoclass.class_moments(table, ["tax"], "y"))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan
    assert plan.count(" Exchange ") == 1


def test_apply_is_a_projection(table):
    scaled = preparation.apply(table, preparation.fit(table, FEATURES), ["k"], 4.0)
    plan = final_plan(scaled)
    assert "Exchange" not in plan and "Join" not in plan


def test_labelling_by_file_order_is_a_projection(spark):
    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_tax")
    plan = final_plan(label_first_rows(df, 1000))
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_histogram_shuffles_counts_only(table):
    plan = final_plan(class_histogram(table, FEATURES, "y"))
    assert "SortMergeJoin" not in plan
    assert "partial_count(1)" in plan


def test_summary_joins_are_broadcasts_of_feature_rows(table):
    plan = final_plan(separation_summary(table, FEATURES, "y"))
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("FileScan") <= 4


@pytest.mark.parametrize("method", ["mannwhitney", "ks", "ttest"])
def test_summary_reads_the_table_twice(spark, table, method, monkeypatch):
    """Once for the profile, which is done when the plan is made, and once for the values."""
    from classlens.plans import separation

    scans = []
    profile = separation.class_profile

    def counted(*args):
        found = profile(*args)
        scans.append("profile")
        return found

    monkeypatch.setattr(separation, "class_profile", counted)
    plan = final_plan(separation_summary(table, FEATURES, "y", method))
    assert plan.count("FileScan") == 1 and scans == ["profile"]


def test_hot_value_is_one_row_after_the_first_shuffle(spark):
    df = spark.range(20000).selectExpr(
        "CAST(id % 2 AS INT) AS y", "IF(id % 3 = 0, 7.0D, CAST(id AS DOUBLE)) AS v"
    )
    rows = ranked.ranked_values(df, ["v"], "y").where("value = 7").collect()
    assert len(rows) == 1 and rows[0]["n0"] + rows[0]["n1"] == 6668


def test_split_limits_shuffle_no_rows_to_meet_their_bucket(table):
    plan = final_plan(splitting.split_limits(table, "k", "y", 0.2, 42))
    assert "BroadcastHashJoin [y" in plan
    assert "SortMergeJoin" not in plan
    assert "hashpartitioning(y" in plan and not any("hashpartitioning(y" in x and "bucket" in x for x in plan.splitlines())


def test_a_fit_on_train_reads_the_split_once_made(table, monkeypatch):
    plans, fit = [], preparation.fit
    monkeypatch.setattr(preparation, "fit", lambda df, *rest: plans.append(final_plan(df)) or fit(df, *rest))
    splits, _ = process_plan.process(table, JobParams(target="y"), "k", False, "train")
    assert "md5" not in plans[0] and "md5" not in final_plan(splits)
