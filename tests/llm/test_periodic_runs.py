"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from classlens.llm.periodic_runs import op13_periodic_runs, periodic_runs, runs_of

SCHEMA = "doc_id long, text string, runs int, key string, `a.b` int"


def brute(w, min_words=6, repeats=4):
    """Every period in turn; a stretch counts under its smallest period only."""
    n, out, seen = len(w), [], set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_words, repeats * q):
                smaller = any(s <= i and e >= i + length and q % p == 0 for s, e, p in seen)
                if not smaller:
                    out.append((i, length, q))
                    seen.add((i, i + length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def sequences():
    rnd = random.Random(13)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 7, [1, 2] * 3, [1, 2] * 4, [1, 2] * 4 + [1], [1] * 300, [1, 2, 3] * 100]
    for _ in range(400):
        w = []
        while len(w) < rnd.randint(1, 80):
            unit = [rnd.randint(0, 3) for _ in range(rnd.randint(1, 6))]
            w += unit * rnd.choice([1, 1, 2, 3, 4, 5, 9])
            w += [rnd.randint(0, 5) for _ in range(rnd.randint(0, 3))]
        out.append(w)
    out += [[rnd.randint(0, 1) for _ in range(200)] for _ in range(60)]
    out.append(([1, 1, 1, 1, 1, 1, 2] * 5 + [3]) * 5)
    return out


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (9, 3), (30, 4)])
def test_runs_of_sequences(limits):
    for w in sequences():
        assert runs_of(np.array(w, np.int64), *limits) == brute(w, *limits), w


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], SCHEMA)


def texts():
    rnd = random.Random(5)
    names = ["a", "b", "é", "A", "x" * 400]
    out = [(i, rnd.choice([" ", "\n", " \t "]).join(names[x % 5] for x in w)) for i, w in enumerate(sequences()[:150])]
    out += [(900, None), (901, ""), (902, " \n\t "), (None, "a " * 9), (903, "a a " * 7), (904, "word " * 30_000)]
    return out + [(904, "q r " * 8), (904, "q r " * 8)]


@pytest.mark.parametrize("chunk", [500, 4 << 20])
def test_operator(spark, monkeypatch, chunk):
    monkeypatch.setattr("classlens.llm.periodic_runs.CHUNK_BYTES", chunk)
    got = sorted(((d, n, [tuple(r) for r in runs], t) for d, n, runs, t in periodic_runs(frame(spark, texts())).collect()), key=repr)
    want = []
    for d, t in texts():
        w = (t or "").encode().split()
        runs = [(0, 30_000, 1)] if len(w) == 30_000 else brute(w)
        want.append((d, len(w), runs, b" ".join(collapsed(w, runs)).decode()))
    assert got == sorted(want, key=repr)


def test_empty_table_and_other_keys(spark):
    assert periodic_runs(frame(spark, [])).collect() == []
    named = spark.createDataFrame([("k\n1", "z " * 6), (None, None)], "`my.key` string, body string")
    assert [tuple(r[:2]) for r in periodic_runs(named, "my.key", "body").orderBy(F.desc("n_words")).collect()] == [("k\n1", 6), (None, 0)]
    exact = named.select(F.lit(1.5).cast("decimal(9,2)").alias("k"), "body")
    assert [float(r.k) for r in periodic_runs(exact, "k", "body").collect()] == [1.5, 1.5]


def test_query(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(301, None), (302, ""), (303, "s t " * 10)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    want, made = [], 0
    for d, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            made += 1
        runs = brute(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        digests = ["".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(collapsed(w, runs))]
        want.append((d, len(runs), *four, *(sha256(x.encode()).hexdigest() for x in digests)))
    assert made > 15
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
