"""Mixing against a plain implementation of shares and Pareto order."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import md5

import pytest

from classlens.llm.mixing import mix, mixed

SCHEMA = "doc_id long, text string, source string, size string, whole long"


def aims(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / max(sum(weight[s] for s in rest), 1e-9)
        over = [s for s in rest if weight[s] * level > most * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * level) for s in order}
        full.update({s: most * sizes[s] for s in over})


def uniform(key):
    digest = md5(("20240601" + ("" if key is None else f"|{key}")).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / 2**52


def inclusion(sizes, rest):
    """Probability per word: the largest documents are certain until the others need no more than one each."""
    left, certain = sorted(sizes, reverse=True), 0
    while left:
        scale = (rest - certain) / sum(n * n for n in left)
        if scale * left[0] <= 1:
            return scale
        largest = left[0]
        certain += sum(n for n in left if n == largest)
        left = [n for n in left if n != largest]
    return 1.0


def odds(key, size, scale):
    p = min(max(min(scale * size, 1.0), 1e-12), 1 - 1e-12)
    u = uniform(key)
    return (u / (1 - u)) / (p / (1 - p))


def brute(rows, ranked=odds):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    target, out = aims(sizes), []
    for s in sizes:
        whole = int(target[s] / max(sizes[s], 1))
        rest = min(target[s] - whole * sizes[s], sizes[s])
        units = defaultdict(int)
        for (d, _, own), n in zip(rows, size):
            if own == s:
                units[d, n] += n
        scale = inclusion([n for (_, _, own), n in zip(rows, size) if own == s and n], rest) if rest > 0 else 1.0
        before, more = 0, set()
        for d, n in sorted(units, key=lambda x: (ranked(x[0], x[1], scale), x[0] is not None, x[0] or 0)):
            if rest > 1e-9 and before + units[d, n] / 2 <= rest:
                more.add((d, n))
            before += units[d, n]
        for (d, _, own), n in zip(rows, size):
            if own == s:
                out.append((d, n, sizes[s], round(target[s], 6), whole + ((d, n) in more)))
    return sorted(out, key=repr)


def test_inclusion_decides(spark):
    """Ranking by the random number alone gives another sample, and long documents are taken more often."""
    rows = documents()
    plain = brute(rows, lambda d, n, scale: uniform(d))
    got = run(spark, rows)
    assert got == brute(rows) != plain
    more = {n: [x[4] - min(y[4] for y in got if y[2] == x[2]) for x in got if x[1] == n] for n in (1, 200)}
    assert sum(more[200]) / len(more[200]) > sum(more[1]) / len(more[1])


def run(spark, rows):
    got = mix(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    return sorted(
        ((r["doc"]["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in got), key=repr
    )


def documents():
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        source = rnd.choice(["hot"] * 6 + ["a", "b", "é", "Z", None])
        rows.append((i, "w " * rnd.choice([0, 1, 3, 10, 50, 200]), source))
    rows += [(900, "w " * 20_000, "a"), (901, None, "b"), (902, "", None), (903, " ", "none"), (None, "x y", "b")]
    return rows + [(7, "w w", rows[7][2]), (904, "one two", "tiny")]


def test_matches_plain_code(spark):
    rows = documents()
    got = run(spark, rows)
    assert got == brute(rows)
    taken, target = defaultdict(int), {}
    for _, size, source_size, aim, copies in got:
        assert copies <= 3
        taken[source_size] += size * copies
        target[source_size] = aim
    for s, n in taken.items():
        assert abs(n - target[s]) <= 10_000  # half of the largest document


def test_mixed_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in documents()], SCHEMA)
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r[-1] for r in brute(documents()))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "s")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_runs_no_python(spark):
    plan = mix(spark.createDataFrame([(1, "a", "s", "x", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
