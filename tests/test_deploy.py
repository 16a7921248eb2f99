from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from classlens.deploy import ship
from classlens.operators.resampling import bootstrap_ci_median
ship(spark)
ship(spark)
df = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
print("rows", bootstrap_ci_median(df, ["v"]).count())
"""


def test_workers_import_the_shipped_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 1" in run.stdout, run.stderr[-2000:]
