"""Stretches of a text that repeat with a period, by uniting suffixes in order of falling common prefix.

The words of a text are numbered and its suffixes sorted. Neighbouring suffixes are then united by descending length of
their longest common prefix (LCP), as Kruskal unites trees: a class is an ordered set of positions, and the smaller set
is dealt into the larger. When two positions become neighbours in a class at LCP l, they are l words alike; at a distance
of at most l (of l / (least repeats - 1) where several periods are asked for) they lie in one run whose smallest period is
their distance. The leftmost such pair of a run gives its start, and the LCP its end, so nothing is extended word by
word. Classes of which the LCP is too small for any run are never united, and texts without a repeated sequence of
that length are not sorted at all. A text is one unit of work: there is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.llm.grams import Words, as_bytes
from classlens.llm.words import words

#: Words at least, and periods at least, of a run.
MIN_WORDS, MIN_REPEATS = 6, 4
#: Text bytes that are looked at together; a longer text is looked at alone.
CHUNK_BYTES = 4 << 20


def _least_lcp(min_words: int, min_repeats: int) -> int:
    """The smallest LCP of two positions that any run can give: a run of period d has LCP length - d."""
    return min(max((min_repeats - 1) * d, min_words - d) for d in range(1, min_words + 1))


def _sorted_suffixes(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and the LCP of each with the one before it (0 for the first).

    Classes of equal prefixes are refined by doubling; only those with several members are sorted again. The ranks of
    every round stay (4 bytes a word, one round for each doubling of the longest repeat) and give the LCPs.
    """
    n = len(names)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds, k = [rank.copy()], 1
    while True:
        single = new & np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) | (rank[np.minimum(at + k, n)] + 1).astype(np.int64)
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        new[slots] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
        rounds.append(rank.copy())
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for r in range(len(rounds) - 1, -1, -1):
        rank = rounds[r]
        x, y = a + lcp[1:], b + lcp[1:]
        inside = (x < n) & (y < n)
        same = inside & (rank[np.minimum(x, n)] == rank[np.minimum(y, n)])
        lcp[1:][same] += 1 << r
    return order, np.minimum(lcp, n)


def _united(order: np.ndarray, lcp: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """``(a, b, LCP)`` of the positions that become neighbours in a class at a distance a run can have."""
    joins = np.flatnonzero(lcp >= least)
    joins = joins[np.argsort(-lcp[joins], kind="stable")].tolist()
    position = order.tolist()
    sets = {}
    parent = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for j in joins:
        length = int(lcp[j])
        reach = length // (repeats - 1)
        x, y = root(j - 1), root(j)
        big, small = sets.get(x) or [position[x]], sets.get(y) or [position[y]]
        if len(big) < len(small):
            big, small, x, y = small, big, y, x
        places = [bisect_left(big, p) for p in small]
        last = len(small) - 1
        for i, (p, at) in enumerate(zip(small, places)):
            if at and (i == 0 or places[i - 1] != at) and p - big[at - 1] <= reach:
                found.append((big[at - 1], p, length))
            if at < len(big) and (i == last or places[i + 1] != at) and big[at] - p <= reach:
                found.append((p, big[at], length))
        if last == 0:
            big.insert(places[0], small[0])
        else:
            big += small
            big.sort()
        parent[y] = x
        sets[x] = big
        sets.pop(y, None)
    return found


def runs_of(names: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the maximal runs in a sequence of numbers, by start, then period."""
    if len(names) < min_words:
        return []
    order, lcp = _sorted_suffixes(names)
    out = []
    for a, b, length in _united(order, lcp, _least_lcp(min_words, min_repeats), min_repeats):
        if length + b - a >= min_words and (a == 0 or names[a - 1] != names[b - 1]):
            out.append((a, length + b - a, b - a))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _names(split: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in split], np.int64)


def _kept(split: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    change = np.zeros(len(split) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [split[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _suspects(texts: list[bytes | None], least: int) -> np.ndarray:
    """Whether a text holds a sequence of ``least`` words twice, as far as hashes tell: none that does is missed."""
    w = Words(texts)
    out = np.zeros(len(texts), bool)
    at = np.flatnonzero(w.within(least))
    if len(at):
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))[at]
        gram = w.hashes(least)[at]
        order = np.lexsort((gram, doc))
        again = (gram[order][1:] == gram[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out[doc[order][1:][again]] = True
    return out


def _chunks(texts: list[bytes | None]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(min_words: int, min_repeats: int):
    least = _least_lcp(min_words, min_repeats)

    def find(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in _chunks(texts):
                counts, runs, kept = [], [], []
                for text, suspect in zip(texts[a:b], _suspects(texts[a:b], least)):
                    split = text.split() if text else []
                    mine = runs_of(_names(split), min_words, min_repeats) if suspect else []
                    counts.append(len(split))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                    kept.append(b" ".join(_kept(split, mine) if mine else split))
                columns = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN))]
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "kept_text"])

    return find


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS
) -> DataFrame:
    """The periodic runs of every text and the text without their repetitions.

    A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least
    ``min_words`` words and ``min_repeats`` periods. Returns ``(key, n_words, runs, kept_text)`` per row; ``runs`` has
    ``(start, length, period)`` by start, then period, in words from 0; ``kept_text`` leaves out each word that a run
    holds after that run's first period, words joined by one space. A null, empty or blank text has no words, no
    run and an empty kept text. Equal words are equal byte for byte. Every row is judged by itself, so repeated rows and
    keys give equal rows, and a null key stays null. Keys may be of any type. Other columns are ignored. Empty in, empty out.
    """
    if min_words < 2 or min_repeats < 2:
        raise ValueError("a run has at least two words and two periods")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(
        _find(min_words, min_repeats),
        f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string",
    )
    return found.withColumnRenamed("key", key)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from a word on for one document in ten, chosen by the CRC-32 of its id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    split = F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(text))  # split once
    return F.when(h % 10 == 0, F.get(split, 0)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    return found.withColumn("first", first).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("first.start").alias("start"),
        (-F.col("first.l")).alias("length"),
        F.col("first.period").alias("period"),
        F.floor(1000 * -F.col("first.l") / F.col("first.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
