"""The Jaccard join against all pairs, and its signatures against the pigeonhole they promise."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from classlens.llm import jaccard_join
from classlens.llm.components import components
from classlens.llm.jaccard_join import Bands, first_of_each, join_components, signatures
from classlens.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, id int, row string, n long"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 4 * both >= 3 * (len(a) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def fixture():
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 2000)}"
    rows, passage = [], [word() for _ in range(60)]
    for size in (1, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200, 600):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for changes in (0, 0, 1, 2, size // 60, size // 30, size // 15):
                copy = list(base)
                for _ in range(changes):
                    at = rnd.randrange(len(copy))
                    if rnd.random() < 0.5:
                        copy[at] = word()
                    else:
                        copy.insert(at, word())
                rows.append(" ".join(copy))
            rows.append(" ".join(base[: size // 2] + passage))
    chain = [word() for _ in range(100)]
    for i in range(25):  # each links with the next ones only
        rows.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    rows += ["", None, " \n ", "One TWO three", "one two THREE", "É b c d e f", "é b c d e f"]
    rows += [" ".join(passage[:k]) for k in range(40, 60)]
    rnd.shuffle(rows)
    out = [(3 * i, t) for i, t in enumerate(rows)]
    return out + [(3, rows[1]), (None, rows[2]), (None, "lone words without any key")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "r", 2) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("batch_bytes", [8_000, 1 << 22])
def test_matches_all_pairs(spark, batch_bytes):
    rows = fixture()
    got = join_components(frame(spark, rows), batch_bytes=batch_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("block", [3, 4096])
def test_common_signatures_in_blocks(spark, monkeypatch, block):
    """Sets that share signatures without linking, so that the second round has pairs to look at."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd, rows = random.Random(3), []
    core = [f"c{i}" for i in range(90)]
    for i in range(40):
        own = [f"o{i}x{j}" for j in range(rnd.choice([8, 14, 20, 26, 30]))]
        rows += [(2 * i, " ".join(own + core)), (2 * i + 1, " ".join(own[3:] + core + own[:3]))]
    got = join_components(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_one_of_each_stays(spark):
    rows = [(d, t) for d, t in fixture()[:120]]
    kept = first_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "row", "n"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_empty_table(spark):
    assert join_components(frame(spark, [])).collect() == []
    assert first_of_each(frame(spark, [(1, None)])).count() == 1


def test_linked_sets_share_a_signature():
    rnd, bands = np.random.RandomState(4), Bands(3, 4)
    for n in [*range(1, 40), 57, 111, 300, 1000]:
        for _ in range(12):
            base = np.unique(rnd.randint(0, 2**62, n).astype(np.uint64))
            drop = rnd.randint(0, n // 4 + 1)
            other = base[rnd.permutation(len(base))[drop:]]
            room = max(0, int(len(other) / 0.75) - len(base))
            other = np.unique(np.concatenate([other, rnd.randint(0, 2**62, rnd.randint(0, room + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 4 * both < 3 * (len(base) + len(other) - both):
                continue
            x, y = dict(signatures(base, bands)), dict(signatures(other, bands))
            assert any(len(np.intersect1d(x[b], y[b])) for b in set(x) & set(y))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)] + [(5, 5)]
    edges += [(rnd.randint(300, 340), rnd.randint(300, 340)) for _ in range(25)]
    group = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(len(group)):
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(group.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_first_of_each_judges_rows(spark):
    """A key that repeats keeps its other texts, and copies under one key leave one row."""
    a, b, c = ("a b c d e f g h " * 3, "p q r s t u v w " * 3, "1 2 3 4 5 6 7 8 " * 3)
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (5, a, "x"), (7, c, "x"), (7, c, "y"), (None, b, "x"), (None, "", "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = sorted(((r[0], r[1]) for r in first_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (7, c), (None, ""), (8, "")], key=repr)
    assert first_of_each(docs.limit(0)).collect() == []
    once = docs.where("doc_id IN (1, 5, 8)")
    assert sorted(r[0] for r in first_of_each(once).collect()) == [1, 8]


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "smallint", "date"])
def test_other_keys_over_several_batches(spark, kind):
    base = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) for i in range(12)]
    rows = [(100 + i, base[i % 12] + (" more" if i % 3 == 0 else "")) for i in range(60)] + [(None, base[0]), (90, None)]
    docs = spark.createDataFrame(rows, "n int, text string")
    cast = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    docs = docs.select(cast.alias("k"), F.col("n"), "text")
    names = {r.k: r.n for r in docs.collect()}
    want = {r.n: r.component_id for r in join_components(docs, "n", batch_bytes=600).collect()}
    got = {names[r.k]: names[r.component_id] for r in join_components(docs, "k", batch_bytes=600).collect()}
    assert got == want and len(set(want.values())) < 30
    removed = {r.n: r.kept_text for r in remove_repeats(docs, "n", window=6, batch_bytes=600).collect()}
    assert {names[r.k]: r.kept_text for r in remove_repeats(docs, "k", window=6, batch_bytes=600).collect()} == removed
