"""Line deduplication against all pairs, and its parts against the built-in edit distance."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from classlens.llm.line_dedup import drop_lines, edits_within, line_classes, segment_keys

SCHEMA = "doc_id long, text string, t int, no string, d long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, line, n):
    out = list(line)
    for _ in range(n):
        at = rnd.randrange(len(out))
        what = rnd.random()
        if what < 0.4:
            out[at] = rnd.choice("abcé ")
        elif what < 0.7:
            out.insert(at, rnd.choice("abcé"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def brute(rows, edits=2, least=20):
    lines = sorted(
        ((d is not None, d or 0), no, x, d)
        for d, t in set(rows)
        if t is not None
        for no, x in enumerate(t.split("\n"))
        if x.encode().split()
    )
    group = {x: x for _, _, x, _ in lines}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    names = sorted(group)
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                group[root(a)] = root(b)
    seen, stays = set(), {}
    for order, no, x, d in lines:
        stays[d, no, x] = root(x) not in seen
        seen.add(root(x))
    out = []
    for d, t in rows:
        parts = [] if t is None else t.split("\n")
        word = [bool(x.encode().split()) for x in parts]
        keep = [not w or stays[d, no, x] for no, (x, w) in enumerate(zip(parts, word))]
        text = None if t is None else "\n".join(x for x, k in zip(parts, keep) if k)
        out.append((d, sum(word), len(keep) - sum(keep), text))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in rows], SCHEMA)
    got = drop_lines(df).select("doc.doc_id", "n_lines", "n_removed", "kept_text").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_matches_all_pairs(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcé defgh") for _ in range(rnd.choice([5, 19, 20, 21, 22, 30, 61, 150]))) for _ in range(25)]
    rows = []
    for i in range(60):
        parts = [edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 4))]
        parts += rnd.choice([[], [""], [" \t"]])
        rows.append((i * 11 % 60, "\n".join(parts)))
    chain = "".join(rnd.choice("abcdefgh") for _ in range(40))
    for i in range(12):  # each within two edits of the next one only
        rows.append((100 + i, chain))
        chain = chain[2:] + "xy" if i % 2 else "q" + chain[:-1]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, base[2]), (203, "x" * 2_000 + "\n" + "x" * 2_001)]
    rows += [(204, "\n".join([base[4]] * 5)), (3, rows[3][1]), (205, "tail\n")]
    assert run(spark, rows) == brute(rows)


def test_full_repeats_share_their_fate(spark):
    rows = [(1, "one line of text that is long"), (1, "one line of text that is long"), (2, "one line of text that is lon")]
    assert run(spark, rows) == [
        (1, 1, 0, "one line of text that is long"),
        (1, 1, 0, "one line of text that is long"),
        (2, 1, 1, ""),
    ]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rnd = random.Random(edits)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(8, 30)))
        b = edited(rnd, a, rnd.randint(0, edits + 2))
        if abs(len(a) - len(b)) <= edits:
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(edits_within(F.col("a"), F.col("b"), edits).alias("x"), (F.levenshtein("a", "b") <= edits).alias("y"))
    assert all(r["x"] == r["y"] for r in got.collect())


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_close_lines_share_a_key(spark, edits):
    rnd = random.Random(edits)
    rows = []
    for i in range(300):
        a = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(20, 60)))
        b = edited(rnd, a, edits)
        if len(b) >= 20:
            rows.append((i, *sorted([a, b], key=len)))
    df = spark.createDataFrame(rows, "i long, a string, b string")

    def keys(c):
        return df.select("i", F.inline(segment_keys(F.col(c), F.char_length(c), edits, 20))).where("k IS NOT NULL")

    met = keys("a").where("own").join(keys("b").drop("own"), ["i", "k"]).select("i").distinct()
    assert met.count() == len(rows)


def test_empty_table_and_bounds(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        line_classes(spark.createDataFrame([], SCHEMA), edits=3, min_chars=6)


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb", 1, "r", 2)], SCHEMA)
    plan = drop_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
