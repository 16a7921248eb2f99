"""Spelling variants against all pairs in plain code, over many small ranges."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from classlens.llm.spelling_variants import letter_runs, number_prefixes, op11_spelling_variants, spelling_variants

SCHEMA = "word string, n long, id int, root string, `a.b` int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    by_length, form, n_near = defaultdict(list), {}, {}
    for w in counts:
        by_length[len(w)].append(w)
    for w, n in counts.items():
        others = [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] > 0 and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary():
    rnd = random.Random(11)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(400)}
    words |= {"prefix" * 3 + "".join(rnd.choice("abÿ") for _ in range(rnd.randint(0, 5))) for _ in range(200)}
    words |= {"x" * k for k in range(1, 40)} | {"y" * 3000, "y" * 3001, "y" * 1500 + "z" + "y" * 1500}
    words |= {"", "😀a", "😀b", "a😀", "￿a", "\U0001f600"}
    counts = {w: rnd.choice([1, 1, 2, 3, 5, 8, 40]) for w in sorted(words)}
    for k, w in enumerate(["chain", "chaim", "chaxm", "cyaxm", "zyaxm", "zyaxmm", "zyaxmmq"]):
        counts[w] = 3 * 2**k
    return counts


def frame(spark, rows):
    return spark.createDataFrame([(w, n, 1, "r", 2) for w, n in rows], SCHEMA)


@pytest.mark.parametrize("range_chars,ratio", [(150, 2), (10_000_000, 2), (700, 3)])
def test_matches_all_pairs(spark, range_chars, ratio):
    counts = vocabulary()
    got = spelling_variants(frame(spark, counts.items()), ratio, range_chars).collect()
    assert sorted(tuple(r) for r in got) == brute(counts, ratio)


@pytest.mark.parametrize("range_chars", [40, 10_000_000])
def test_nodes_are_prefixes(spark, range_chars):
    words = list(vocabulary())
    rows = number_prefixes(spark.createDataFrame([(w,) for w in words], "word string"), range_chars).collect()
    nodes = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for i, x in enumerate(r.nodes[:60]):
            assert nodes.setdefault(r.word[:i], x) == x
    assert len(set(nodes.values())) == len(nodes)
    ends = [r.nodes[-1] for r in sorted(rows, key=lambda r: r.word)]
    assert ends == sorted(set(ends)) and len(rows) == len(words)


def test_nulls_repeats_and_empty(spark):
    rows = [("abcde", 2), ("abcde", 3), (None, 7), ("abcdf", 1), ("abcdg", None), ("zzzzz", None)]
    got = spelling_variants(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute({"abcde": 5, "abcdf": 1, "abcdg": 0, "zzzzz": 0})
    assert spelling_variants(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(frame(spark, rows), 1)


def test_letter_runs(spark):
    rows = [("ABCDE fghiÀÿ x-yzzzzz1abcde",), (None,), ("",), ("Ā" * 9 + "A" * 60_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(letter_runs(F.col("t"))).collect()]
    assert got == [["abcde", "fghiÀÿ", "yzzzzz", "abcde"], [], [], ["a" * 60_000]]


def test_query(spark, tmp_path):
    rnd = random.Random(2)
    pool = ["".join(rnd.choice("abcdeÉé") for _ in range(rnd.randint(3, 7))) for _ in range(90)]
    pool += [p[:-1] + "z" for p in pool] + [p.upper() for p in pool[:20]]
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 80)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "Y" * 9000), (303, "y" * 9000), (304, "y" * 8999 + "é")]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    counts, changed = Counter(), 0
    upper = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate(upper)
            h = zlib.crc32(f"{d}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
                changed += 1
            counts[word] += 1
    kept = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert changed > 20 and len(kept) > 80
    assert sorted(tuple(r) for r in op11_spelling_variants(spark, str(tmp_path)).collect()) == brute(kept)
