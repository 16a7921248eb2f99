from __future__ import annotations

import json

import numpy as np
import pytest

from classlens.params import JobParams
from classlens.plans.job import FeatureJob
from classlens.sources.workdir import shared_folder


@pytest.fixture()
def csv_file(tmp_path):
    rng = np.random.default_rng(0)
    lines = ["a,b,c"] + [f"{x:.6f},{y:.6f},1.0" for x, y in rng.normal(size=(200, 2))]
    lines[5] = "-999,0.5,1.0"
    lines.append(lines[-1])
    path = tmp_path / "rows.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_whole_job(spark, csv_file):
    job = FeatureJob(spark, JobParams(n_features=3, number_of_signals=56, number_of_background=145))
    loaded = job.load(csv_file)
    assert loaded.count() == 201 and job.feature_names() == ["feature_0", "feature_1", "feature_2"]
    assert all(r["matches"] for r in job.class_count_check().collect())
    splits = job.process()
    assert splits.count() == 200  # the copied last row is gone
    assert splits.columns == ["row_number", "split", "signal", "feature_0", "feature_1", "is_outlier"]
    shapes = {r["split"]: (r["n_rows"], r["n_features"]) for r in job.split_shapes().collect()}
    assert shapes == {"test": (40, 3), "train": (160, 3)}
    assert job.split("train", as_vector=True).count() == 160
    summary = job.data_summary().first()
    assert summary["total_samples"] == 200 and summary["missing_values"] == 0
    assert job.class_distribution().first()["n"] == 144
    assert job.profile().count() == 3

    base = shared_folder(spark, "job-test")
    job.save_splits(f"{base}/splits")
    job.export_params(f"{base}/params")
    job.export_lineage(f"{base}/lineage")
    facts = json.loads(spark.read.text(f"{base}/lineage").first()[0])
    assert facts["data_path"] == csv_file and "process_timestamp" in facts["facts"]

    other = FeatureJob(spark)
    other.load_params(f"{base}/params")
    again = other.transform(job.df, ("row_number",)).orderBy("row_number").collect()
    want = splits.select("row_number", "feature_0", "feature_1").orderBy("row_number").collect()
    assert again == want


def test_cached_job(spark, csv_file):
    base = shared_folder(spark, "job-cache")
    rows = []
    for _ in range(2):
        job = FeatureJob(spark, JobParams(n_features=3, number_of_signals=56))
        job.load(csv_file)
        rows.append(sorted(map(str, job.process(cache=base).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 200


def test_steps_out_of_order(spark):
    job = FeatureJob(spark)
    for step in (job.clean, job.process, job.data_summary, job.split_shapes, job.lineage):
        with pytest.raises(ValueError):
            step()
    for call in (lambda: job.split("test"), lambda: job.transform(spark.range(1)), lambda: job.export_params("x")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        job.use_table(spark.range(3))
