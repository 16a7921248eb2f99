"""Packing: every id in one piece, sequences full and gapless, ids as the tokenizer gives them."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from classlens.llm import packing
from classlens.llm.packing import _Index, _least, _mixed, _order, _terms, _topics, pack, pieces
from classlens.llm.tokens import Encoder, default_ranks, default_tokenizer

SCHEMA = "doc_id long, text string, ids int, row string"


def texts():
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "über", "don't", "x1", "##", "the", "of", "\n", "été"]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 5, 80, 400, 3000]))) for _ in range(150)]
    return out + ["", None, " \n\t ", "漢字 \x1c a\x85b ½ ٣ 😀", "<|endoftext|> is text", "A\r\n\r\nB", "a" * 9000]


def check(rows, data, length):
    reference = Tokenizer.from_file(default_tokenizer())
    reference.encode_special_tokens = True
    want = Counter()
    for key, text in data:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [1]
        want[(key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got, sequences, padding = defaultdict(list), defaultdict(list), 0
    for r in rows:
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) // 4 > 0
    for places in sequences.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
        padding += length - end
    found = Counter()
    for key, mine in got.items():
        assert sum(r["length"] for r in mine) == sum(n * c for (k, n, _), c in want.items() if k == key)
        if sum(c for (k, *_), c in want.items() if k == key) == 1:
            whole = b"".join(r["ids"] for r in sorted(mine, key=lambda r: r["start"]))
            found[(key, mine[0]["doc_tokens"], zlib.crc32(whole))] += 1
        else:
            for x in [x for x in want if x[0] == key]:
                found[x] = want[x]
    assert found == want
    return padding


@pytest.mark.parametrize("shard_tokens", [3_000_000, 20_000])
def test_round_trip(spark, shard_tokens):
    data = [(i, t) for i, t in enumerate(texts())] + [(7, "again"), (7, "again"), (None, "no key")]
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in data], SCHEMA).coalesce(1)
    padding = check(pack(df, shard_tokens=shard_tokens).collect(), data, 2048)
    total = sum(r["length"] for r in pack(df).collect())
    assert padding <= 2048 * (total // shard_tokens + 1)


def test_reruns_agree(spark):
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts())], SCHEMA)
    assert sorted(pieces(df).collect()) == sorted(pieces(df).collect())


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranks_give_the_tokenizers_ids():
    fast, slow = Encoder(default_tokenizer(), default_ranks()), Encoder(default_tokenizer(), None)
    odd = ["a  b\t\n c", "x y", "é́ l'été’s I'll", "\x1c a \x85 b", "123 ²³ ½ ٣", "ª µ º ÿ ɏ ¿", "\n\n \n x", "漢字 😀"]
    for text in [*odd, *filter(None, texts())]:
        assert fast.encode(text) == slow.encode(text)


def test_neighbours_match_brute_force_bm25():
    rnd = random.Random(1)
    docs = [np.array([rnd.randint(0, 40) for _ in range(rnd.randint(1, 30))], "<u2") for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=41)
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    index, unused = _Index(docs, idf, mean), np.ones(60, bool)
    unused[[3, 9]] = False
    for seed in (0, 3, 20):
        score = np.zeros(60)
        for t in index.terms(seed):
            for i, d in enumerate(docs):
                tf = np.sum(d == t)
                if tf:
                    score[i] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        order = [i for i in np.argsort(-np.round(score, 9), kind="stable") if score[i] > 0 and unused[i]]
        got = index.ranked(seed, unused)
        assert np.allclose(score[got], score[order])
        assert set(got) == set(order)


def test_all_terms_of_a_seed_count():
    rnd = random.Random(2)
    # The heaviest 30 terms of each document occur in no other one; the rest decide.
    docs = [np.array([100 + 30 * i + j for j in range(30)] + [rnd.randint(0, 59) for _ in range(60)], "<u2") for i in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=100 + 30 * 40)
    idf = np.log1p((40 - df + 0.5) / (df + 0.5))
    index = _Index(docs, idf, 90.0)
    for seed in range(40):
        unused = np.arange(40) != seed
        score = np.zeros(40)
        for t in set(docs[seed].tolist()):
            tf = np.array([np.sum(d == t) for d in docs])
            score += idf[t] * tf * 2.2 / (tf + 1.2)  # all documents have the mean length
        got = index.ranked(seed, unused)
        assert set(got) == set(np.flatnonzero((score > 0) & unused)) and len(got) == 39
        assert np.allclose(score[got], np.sort(score[unused])[::-1])


def test_copies_far_apart_share_a_window(spark):
    rnd = random.Random(4)
    docs = [" ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99)) for _ in range(350)) for _ in range(60)]
    near = [f"{d} {rnd.randint(0, 9)}" for d in docs]
    data = list(enumerate(docs)) + [(60 + i, near[i]) for i in rnd.sample(range(60), 60)]
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in data], SCHEMA).coalesce(1)
    rows = pack(df, shard_tokens=8_000).collect()
    check(rows, data, 2048)
    held = defaultdict(set)
    for r in rows:
        held[r["doc_id"]].add(r["sequence_id"])
    assert len({r["sequence_id"] for r in rows}) > 30
    assert sum(bool(held[i] & held[60 + i]) for i in range(60)) >= 40


def test_many_copies_are_split(spark):
    data = [(i, "the same text of many rows " * 20) for i in range(400)] + [(400 + i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in data], SCHEMA)
    rows = pack(df, shard_tokens=4_000).collect()
    check(rows, data, 2048)
    tasks = Counter(r["sequence_id"] >> 32 for r in rows if r["doc_id"] < 400 and r["start"] == 0)
    assert max(tasks.values()) < 200


def test_texts_encoded_at_once_have_the_tokenizers_ids():
    rnd = random.Random(3)
    signs = ["'", "'s", "'re", "'ll", "'v", "e", "s", "t", "l", "d", "m", " ", "  ", "\n", "\t", "\r", "a", "Z", "é", "½", "3", "²", "!"]
    signs += ["#", "¡", "ɏ", "ª", "\xad", "×", " the", "漢", "\0", "\x1c", "😀", "<|endoftext|>"]
    data = ["".join(rnd.choice(signs[: rnd.choice([29, 30, 35])]) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    data += [*texts(), "", None, " ", "\n", "'", "''s", "x'", "'re", "a'r"]
    reference = Tokenizer.from_file(default_tokenizer())
    reference.encode_special_tokens = True
    want = [np.array([*ids.ids, 1], "<u2").tobytes() for ids in reference.encode_batch([t or "" for t in data], add_special_tokens=False)]
    for tokens in (Encoder(default_tokenizer(), default_ranks()), Encoder(default_tokenizer(), None)):
        assert tokens.encode_all(data, 1) == want
    assert Encoder(default_tokenizer(), default_ranks()).encode_all(["\n \t", " "], 1) == tokens.encode_all(["\n \t", " "], 1)
    assert tokens.encode_all([], 1) == []


def test_topics_and_least_hashes_are_those_of_single_rows():
    rnd = np.random.default_rng(6)
    docs = [rnd.integers(0, 300, n).astype("<u2") for n in [1, 2, 3, 4, 5, 6, 1, 40, 900, 4, 5]]
    df, idf = rnd.integers(0, 200, 300).astype(float), rnd.random(300)
    flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    row, term, tf = _terms(flat, sizes)
    topics, least = _topics(flat, sizes, df, idf), _least(flat, sizes)
    for i, d in enumerate(docs):
        own, n = np.unique(d, return_counts=True)
        assert term[row == i].tolist() == own.tolist() and tf[row == i].tolist() == n.tolist()
        weight = np.where(df[own] >= packing.SHARED, idf[own] * n / (n + packing.K1), -1)
        assert topics[i] == (own[np.argmax(weight)] if weight.max() >= 0 else -1)
        run, hashes = min(packing.SHINGLE, len(d)), []
        for a in range(len(d) - run + 1):
            x = np.zeros(1, np.uint64)
            for j in d[a : a + run].astype(np.uint64):
                x = _mixed(x * np.uint64(31) + j + np.uint64(1))
            hashes.append(int(x[0]))
        assert least[i] == min(hashes) >> 1


def test_order_is_that_of_the_whole_index(monkeypatch):
    rnd = random.Random(7)
    docs = [np.array([rnd.randint(0, 60) for _ in range(rnd.randint(1, 60))], "<u2") for _ in range(400)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=61)
    idf, mean = np.log1p((400 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    got = list(_order(docs, _Index(docs, idf, mean), 100))
    monkeypatch.setattr(packing, "KEPT", 0)
    monkeypatch.setattr(packing, "HEAD", 10_000)
    assert got == list(_order(docs, _Index(docs, idf, mean), 100)) and sorted(got) == list(range(400))


def test_ids_are_staged_once(spark, monkeypatch):
    staged = []

    def stage(df, purpose):
        staged.append((purpose, "ids" in df.columns))
        return keep(df, purpose)

    keep = packing.stage
    monkeypatch.setattr(packing, "stage", stage)
    pack(spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts())], SCHEMA))
    assert staged == [("tokens", True), ("groups", False)]
