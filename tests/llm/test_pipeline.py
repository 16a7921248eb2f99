"""The pipeline against the brute-force versions of its stages, one after the other."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import test_jaccard_join, test_line_dedup, test_mixing, test_packing, test_quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    shared = [" ".join(word() for _ in range(6)) for _ in range(8)]
    rows = []
    for i in range(150):
        text = "\n".join(" ".join(word() for _ in range(rnd.randint(5, 40))) for _ in range(rnd.randint(1, 6)))
        what = i % 10
        if what in (1, 2) and rows:
            text = rnd.choice(rows)[1] or ""
            if what == 2:
                words = text.split(" ")
                words[rnd.randrange(len(words))] = word()
                text = " ".join(words)
        elif what == 3:
            text = text.replace(" ", "%%% ")
        elif what == 4:
            text += "\n" + rnd.choice(shared)
        rows.append((i, text, rnd.choice(["en", "de"]), rnd.choice(["hot", "hot", "hot", "a", "b", None])))
    rows += [(500, None, "en", "a"), (501, "", "de", "b"), (502, "w " * 4000, "en", "hot")]
    return [(*r, len(r[1] or "")) for r in rows]


def expected(rows):
    """Rows after each of the first four stages."""
    good = {r[0] for r in test_quality_rules.brute([r[:4] for r in rows]) if r[-1]}
    rows = [r for r in rows if r[0] in good]
    yield rows
    lines = {r[0]: r for r in test_line_dedup.brute([r[:2] for r in rows])}
    rows = [(r[0], lines[r[0]][3], r[2], r[3], len(lines[r[0]][3])) for r in rows if lines[r[0]][1] > lines[r[0]][2]]
    yield rows
    first = {r[0] for r in test_jaccard_join.brute([r[:2] for r in rows]) if r[0] == r[2]}
    rows = [r for r in rows if r[0] in first]
    yield rows
    copies = {r[0]: r[-1] for r in test_mixing.brute([(r[0], r[1], r[3]) for r in rows])}
    yield [r for r in rows for _ in range(copies[r[0]])]


def test_stages_match_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    for (name, step), want in zip(corpus_pipeline.STAGES, expected(rows)):
        docs = step(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = [tuple(r) for r in docs.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        docs = spark.createDataFrame(want, SCHEMA)
    total = sum(r["length"] for r in corpus_pipeline.packing(spark, docs, "").collect())
    assert total == sum(r["length"] for r in test_packing.pack(docs).collect())
    assert test_packing.check(test_packing.pack(docs).collect(), [r[:2] for r in want], 2048) < 2048 * 20


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_tiny_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_on_the_smallest_scale(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ends = {}
    for r in sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert ends and max(ends.values()) <= 2048
