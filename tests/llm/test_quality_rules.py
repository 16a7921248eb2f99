"""Quality rules against a plain implementation."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from classlens.llm.quality_rules import judge

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept string"
LEAST = {"symbols": 0.01, "lines": 0.15, "repeats": 0.09}


def measure(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    chars, symbols = sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    dup, n = len(lines) - len(set(lines)), len(words)
    shares = {
        "symbols": symbols / chars if chars else 0.0,
        "lines": dup / len(lines) if lines else 0.0,
        "repeats": len(covered) / n if n else 0.0,
    }
    return (n, chars, symbols, dup, len(covered), n < 20 or 100 * len(covered) > 30 * n), shares


def brute(rows):
    measured = [(*r, *measure(r[1])) for r in rows]
    groups = defaultdict(list)
    for _, _, lang, source, _, shares in measured:
        for g in ((lang, source), lang, ()):
            groups["" if g == () else ("g", g)].append(shares)

    def fences(lang, source):
        own = next((g for g in (("g", (lang, source)), ("g", lang)) if len(groups[g]) >= 50), "")
        out = {}
        for m, least in LEAST.items():
            values = sorted(s[m] for s in groups[own])
            low, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
            out[m] = high + 3.0 * max(high - low, least)
        return out

    return sorted(
        ((d, *counts, not counts[-1] and all(shares[m] <= f for m, f in fences(lang, source).items())))
        for d, _, lang, source, counts, shares in measured
    )


def run(spark, rows):
    out = judge(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    return sorted(map(tuple, out.collect()))


def documents(n=260):
    rnd, rows = random.Random(6), []
    for i in range(n):
        words = [rnd.choice(["é", "ab", "cde", "x&y", "#", "longer", "ß|"]) + str(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.3:
            words += words[: rnd.randint(0, 40)]
        text = "".join(w + rnd.choice([" ", " ", "\n", "\t", "\n\n"]) for w in words)
        if rnd.random() < 0.3:
            text = "\n".join([text.split("\n")[0]] * 3) + "\n" + text
        if rnd.random() < 0.15:
            text = text.replace(" ", "%%% ")
        rows.append((i, text, rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "b", None])))
    rows += [(1000, None, "en", "a"), (1001, "", "fr", None), (1002, " \n\t\n", None, None)]
    return rows + [(1003, "w " * 5000, "en", "a"), (1004, rows[5][1], "en", "b"), (1004, rows[5][1], "en", "b")]


def test_matches_plain_code(spark):
    rows = documents()
    assert run(spark, rows) == brute(rows)


def test_columns_with_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 7, "mine")], SCHEMA)
    assert judge(df).select("doc.*").collect() == df.collect()


def test_empty_table(spark):
    assert run(spark, []) == []


def test_runs_no_python(spark):
    plan = judge(spark.createDataFrame([(1, "a", "en", "s", 7, "x")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
