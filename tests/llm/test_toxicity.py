"""Ordinal severity: gradients, held-out accuracy, and defined results for odd rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from classlens.llm.toxicity import fit, fit_ordinal, severity

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, toxic int, grade string, key long"


def test_fit_recovers_ordered_grades():
    rnd = np.random.RandomState(0)
    truth, cuts = np.array([2.0, 1.0, -1.0, 0.0]), np.array([0.5, 2.0])
    rows = [np.flatnonzero(rnd.rand(4) < 0.5) for _ in range(6000)]
    noise = np.log(1 / rnd.rand(6000) - 1)
    score = np.array([truth[r].sum() for r in rows]) + noise
    grades = (score[:, None] > cuts).sum(axis=1)
    weights, found = fit_ordinal(rows, grades, 4)
    assert np.abs(weights - truth).max() < 0.2 and np.abs(found - cuts).max() < 0.2
    assert found[0] < found[1]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(4)) == 0
    model = fit(docs, labels.where(~held))
    truth = labels.where(held).select("doc_id", F.col("toxic").alias("y"))
    rows = severity(docs, model).join(truth, "doc_id").collect()
    bad = [r for r in rows if r["y"] == 1]
    clean = [r for r in rows if r["y"] == 0]
    assert len(bad) > 60 and len(clean) > 500
    assert sum(r["toxic"] for r in bad) / len(bad) > 0.85  # some carry no word of the kind
    assert sum(r["toxic"] for r in clean) / len(clean) < 0.01


def test_grades_rise_with_the_share_of_bad_words(spark):
    rnd, rows = random.Random(1), []
    for i in range(600):
        words = [f"w{chr(97 + rnd.randint(0, 25))}{chr(97 + rnd.randint(0, 25))}" for _ in range(40)]
        if i % 3 == 0:
            words[: 1 + i % 9] = [rnd.choice(["awful", "nasty", "rotten", "vilest"]) for _ in range(1 + i % 9)]
        rows.append((i, " ".join(words), int(i % 3 == 0), "x", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit(df, df)
    texts = ["wab wcd", "awful wab", "awful nasty rotten vilest", None, "", "é" * 10_000 + " awful"]
    odd = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)] + [(1, texts[1], 0, "x", 1)], SCHEMA)
    got = sorted((r["doc_id"], r["expected_severity"], r["toxic"]) for r in severity(odd, model).collect())
    s = {d: e for d, e, _ in got}
    assert s[0] < s[1] < s[2] and s[3] == s[4] == s[0]
    assert [t for _, _, t in got][:2] == [False, True] and len(got) == 7
    assert np.all(np.diff(model.cuts) > 0)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", 0, "x", 1), (2, None, None, "x", 1)], SCHEMA)
    assert fit(df, df) is None and fit(df, df.limit(0)) is None and fit(df.limit(0), df) is None
    assert [r["expected_severity"] for r in severity(df, None).collect()] == [0.0, 0.0]
    assert severity(df.limit(0), None).collect() == []
