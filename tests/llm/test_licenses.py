"""Licence scan: variants of a text find their licence, other texts do not."""

from __future__ import annotations

import textwrap

import pytest

from classlens.llm.licenses import KNOWN, SPELLINGS, known_texts, scan

SCHEMA = "doc_id long, text string, license string, digest long, row int"
MIT = next(t for n, t in KNOWN if n == "MIT")


def run(spark, texts, known=None):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    out = scan(df, known_texts(spark, known)).collect()
    return sorted((r["doc_id"], r["license"], r["line_licenses"], r["n_license_lines"]) for r in out)


def test_every_known_text_is_found(spark):
    got = run(spark, [t for _, t in KNOWN])
    assert [g[1] for g in got] == [n for n, _ in KNOWN]


def test_variants(spark):
    texts = [
        "Copyright (c) 2020 Some Body <a@b.c>\nAll rights reserved.\n\n" + MIT.upper(),
        MIT.replace(" ", " \t ").replace('"', "“").replace("sublicense", "sub-licence"),
        MIT + " Or not.",
        "intro\nReleased under the MIT licence\nmore\nLICENSED UNDER CC BY-NC 4.0!\nlicensed under cc by nc 4 0\n",
        None,
        "",
        " \n#!?\n",
        "© 1999 nobody",
        "word " * 40_000 + "\nSPDX-License-Identifier: MIT",
    ]
    assert run(spark, texts) == [
        (0, "MIT", "", 0),
        (1, "MIT", "", 0),
        (2, None, "", 0),
        (3, None, "CC-BY-NC-4.0,MIT", 3),
        (4, None, "", 0),
        (5, None, "", 0),
        (6, None, "", 0),
        (7, None, "", 0),
        (8, None, "MIT", 1),
    ]


@pytest.mark.parametrize("variant,word", SPELLINGS)
def test_spellings_are_words_apart(variant, word):
    assert variant != word and variant == variant.lower()


@pytest.mark.parametrize("width", [20, 60, 70, 78, 100, 1_000_000])
def test_wrapping_does_not_count(spark, width):
    def wrapped(text, mark=""):
        whole = dict(break_long_words=False, break_on_hyphens=False, initial_indent=mark, subsequent_indent=mark)
        return "\n\n".join(textwrap.fill(" ".join(p.split()), width, **whole) for p in text.split("\n\n"))

    notice = "Copyright (c) 2019-2021 Some Body with a Long Name and Others <a@b.c>. All rights reserved."
    texts = [wrapped(t) for _, t in KNOWN] + [wrapped(f"{notice}\n\n{t}") for _, t in KNOWN]
    texts += [wrapped(t, " * ").replace("\n\n", "\n *\n") for _, t in KNOWN]
    assert [g[1] for g in run(spark, texts)] == [n for n, _ in KNOWN] * 3


def test_only_real_notices_go(spark):
    end = "\nCOPYRIGHT HOLDERS"
    head = ["Copyright 2020 A", "copyright © B", "Copyright The Some Authors.", "COPYRIGHT (C) 2020 A\r", "(c) 2020 C", "# All Rights Reserved.\n"]
    texts = [f"{x}\n{MIT}" for x in head]
    texts += [MIT.replace(end, end + " MAY SUE AND"), MIT.replace("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "X")]
    texts += [MIT + "\n(c) you must pay", MIT + "\ncopyright law of Ruritania applies"]
    assert end in MIT
    assert [g[1] for g in run(spark, texts)] == ["MIT"] * 6 + [None] * 4


def test_own_table_repeats_and_empty(spark):
    assert run(spark, ["One two.", "one TWO", "one two three"], [("B", "one two"), ("A", "One, two")]) == [
        (0, "A", "A", 1),
        (1, "A", "A", 1),
        (2, None, "", 0),
    ]
    df = spark.createDataFrame([(1, "One", "x", 1, 2)] * 2, SCHEMA)
    assert scan(df, known_texts(spark, [("B", "one")])).count() == 2
    assert run(spark, []) == [] and run(spark, ["a"], [])[0][1] is None


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, 2)], SCHEMA)
    plan = scan(df, known_texts(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
