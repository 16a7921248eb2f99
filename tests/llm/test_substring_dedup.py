"""Substring deduplication against brute force over many small batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from classlens.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, batch string, id int, part int"


def brute(rows, window):
    seen, out = set(), []
    docs = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for d, t in docs:
        words = t.encode().split()
        gone = set()
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                gone.update(range(p, p + window))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((d, len(words), len(gone), kept))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("window,batch_bytes", [(20, 1500), (20, 1 << 20), (7, 900)])
def test_matches_brute_force(spark, window, batch_bytes):
    rnd = random.Random(window)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß", "x" * 700]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(passages)
        rows.append((i * 7 % 120, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(12)]  # copies
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a b a b " * 40), (5, rows[0][1]), (None, rows[1][1])]
    rows += [(304, "word " * 3000)]
    got = remove_repeats(frame(spark, rows), window=window, batch_bytes=batch_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, window)


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def test_string_key(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.StringType())])
    rows = [("a", "1 2 3 4 5"), ("b", "0 1 2 3 4 9")]
    got = remove_repeats(spark.createDataFrame(rows, schema), "k", "t", window=4, batch_bytes=1 << 20)
    assert sorted(map(tuple, got.collect())) == [("a", 5, 0, "1 2 3 4 5"), ("b", 6, 4, "0 9")]


def test_one_word_windows_are_refused(spark):
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, []), window=1)
