"""Exact deduplication against grouping by the text, also when digests clash."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from classlens.llm import exact_dedup
from classlens.llm.exact_dedup import drop_equal

SCHEMA = "doc_id long, text string, name long, row string, i int"
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(UPPER)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        kept = False
        for d in sorted(ids, key=lambda d: (d is not None, d or 0)):
            mine = d == keep and not kept
            kept |= mine
            out.append((d, keep, len(ids), mine, sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abÄß c\n") for _ in range(rnd.choice([0, 1, 7, 8, 9, 63, 64, 65, 300]))) for _ in range(40)]
    out = [(i, rnd.choice(texts)) for i in range(150)]
    out += [(200, "Same TEXT"), (201, "same text"), (202, "SAME text "), (203, "É"), (204, "é")]
    out += [(205, None), (206, ""), (207, "x" * 50_000), (208, "X" * 50_000), (None, "lone"), (209, "y"), (209, "y")]
    out += [(210, "a" * 16), (211, "a" * 24), (212, "a" * 32)]
    return out


def run(spark, data, **kw):
    df = spark.createDataFrame([(d, t, 1, "r", 0) for d, t in data], SCHEMA)
    return sorted((tuple(r) for r in drop_equal(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("size", [8, 4096])
def test_matches_grouping(spark, size):
    assert run(spark, rows(), block_bytes=size) == brute(rows())


def test_clashing_digests(spark, monkeypatch):
    short = lambda b: [F.octet_length(b).cast("long").alias("d"), F.lit(0).alias("e")]
    monkeypatch.setattr(exact_dedup, "_digest", short)
    assert run(spark, rows(), block_bytes=8) == brute(rows())


def test_empty_table(spark):
    assert run(spark, []) == []


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a", 1, "r", 0)], SCHEMA)
    plan = drop_equal(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
