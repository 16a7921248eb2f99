"""Words that differ by one code point, found as equal pairs of trie nodes.

The distinct words are sorted and their trie is numbered without being built: a prefix belongs to the first word that
has it, so its node is that word's offset plus the prefix length, and each word takes over the nodes that it shares
with the word before. The same with reversed words numbers the suffixes. A word of n code points then gives n + 1
whole pairs (node of a prefix, node of the suffix that follows) and n pairs that skip one code point. Words with an equal
skipping pair differ by one replaced code point there; a skipping pair that equals a whole one of another word is
one code point left out or put in. Pairs are two integers, so nothing is compared as text and nothing is approximate;
a word's whole pair is its own alone, and words that share a skipping pair differ in one place, so that a pair has
at most one whole row and a row per letter of the alphabet.

Sorted words are cut into ranges by length in code points. A range is numbered in one task as if it were alone; the nodes that its
first word shares with the word before are then replaced by a table with a row per range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.llm.exact_dedup import ascii_lower
from classlens.sources.workdir import stage

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT = 5, 3
#: A form is this many times as frequent as the word.
RATIO = 2
#: Code points of the words of a range; a range is one task's work.
RANGE_CHARS = 500_000
#: Nodes of a range are numbered from its number times this.
_RANGE = 1 << 40


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


_PATHS = pa.schema([("range", pa.int64()), ("word", pa.string()), ("nodes", pa.list_(pa.int64())), ("last", pa.bool_())])


def _number(key, table):
    """The nodes of the prefixes of every word of a range, from the empty one to the word itself."""
    words = sorted(table.column("word").to_pylist())
    start = key[0].as_py() * _RANGE
    paths, path, before = [], [], ""
    for i, word in enumerate(words):
        keep = _shared(before, word) + 1 if i else 0
        path = path[:keep] + list(range(start + keep, start + len(word) + 1))
        paths.append(path)
        start += len(word) + 1
        before = word
    last = [False] * (len(words) - 1) + [True]
    return pa.table({"range": [key[0].as_py()] * len(words), "word": words, "nodes": paths, "last": last}, schema=_PATHS)


def _borders(ends: list) -> list[tuple[int, list[int]]]:
    """Per range, the true nodes of the prefixes that its first word shares with the word before it."""
    out, path, before = [], [], None
    for row in ends:
        first = row["range"] * _RANGE
        shared = path[: _shared(before, row["first"]) + 1] if before is not None else []
        out.append((row["range"], shared))
        path = [shared[x - first] if x - first < len(shared) else x for x in row["nodes"]]
        before = row["word"]
    return out


def number_prefixes(words: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """``(word, nodes)`` of distinct words: one integer per prefix, equal exactly for equal prefixes.

    Nodes grow with the order of the words, and the last node of a word is its own. A row per range, with the first and
    the last word and its path, reaches the driver; ranges grow with the vocabulary: a billion words of ten code points have 20,000.
    """
    spark = words.sparkSession
    total = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    n = max(1, math.ceil(total / range_chars))
    ranged = words.select("word").repartitionByRange(n, "word").select(F.spark_partition_id().cast("long").alias("range"), "word")
    ranged = stage(ranged, "ranges")
    numbered = stage(
        ranged.groupBy("range").applyInArrow(_number, "range long, word string, nodes array<long>, last boolean"), "paths"
    )
    firsts = ranged.groupBy("range").agg(F.min("word").alias("first"))
    ends = numbered.where("last").join(firsts, "range").orderBy("range").collect()
    borders = spark.createDataFrame(_borders(ends), "range long, shared array<long>")
    true = lambda x: F.coalesce(F.get("shared", (x - F.col("range") * _RANGE).cast("int")), x)
    nodes = F.when(F.size("shared") > 0, F.transform("nodes", true)).otherwise(F.col("nodes"))
    return numbered.join(borders, "range").select("word", nodes.alias("nodes"))


def _pairs(words: DataFrame) -> DataFrame:
    """``(p, s, kind, id, n)``: whole pairs (0), skipping pairs (1), those that skip a code point equal to the one before (2).

    A word without one of several equal code points in a row is the same word whichever is skipped; kind 2 keeps
    those from counting twice.
    """
    size = F.size("prefixes") - 1
    whole = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(F.get("prefixes", i).alias("p"), F.get("suffixes", size - i).alias("s"), F.lit(0).alias("kind")),
    )
    letters = F.split("word", "")
    same = lambda i: (i > 0) & (F.get("letters", i) == F.get("letters", i - 1))
    skipping = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("prefixes", i).alias("p"),
            F.get("suffixes", size - 1 - i).alias("s"),
            F.when(same(i), 2).otherwise(1).alias("kind"),
        ),
    )
    rows = words.withColumn("letters", letters).select("id", "n", F.explode(F.concat(whole, skipping)).alias("x"))
    return rows.select("x.*", "id", "n")


_NEAR = "id long, n_near long, n long, other long"


def _met(p, s, kind, n, word):
    """Near words found in whole groups of equal pairs, in the order of ``_neighbours``."""
    new = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    if new.all():
        return
    start = np.flatnonzero(np.concatenate([[True], new]))
    size = np.diff(np.append(start, len(p)))
    start, size = start[size > 1], size[size > 1]
    group = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(group))
    kind, n, word = kind[at], n[at], word[at]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    whole = kind[first] == 0  # it comes first in its group
    skips = size - whole
    top = first + whole  # the skipping row of largest n, then the second
    second = np.minimum(top + 1, len(group) - 1)
    once = np.flatnonzero(kind == 1)
    n_once = np.bincount(group[once], minlength=len(start))
    first_once = np.full(len(start), -1)
    first_once[group[once][::-1]] = once[::-1]

    row = np.flatnonzero(kind > 0)
    mine = group[row]
    best = np.where(row == top[mine], second[mine], top[mine])
    has = skips[mine] > 1
    shorter = (kind[row] == 1) & whole[mine]
    near_n, near = np.where(has, n[best], -1), np.where(has, word[best], -1)
    w_n, w = n[first][mine], word[first][mine]
    better = shorter & ((w_n > near_n) | ((w_n == near_n) & (w < near)))
    near_n, near = np.where(better, w_n, near_n), np.where(better, w, near)
    count = skips[mine] - 1 + shorter

    lone = np.flatnonzero(whole & (n_once > 0))
    longer = first_once[lone]
    ids = np.concatenate([word[row], word[first[lone]]])
    counts = np.concatenate([count, n_once[lone]])
    near_n, near = np.concatenate([near_n, n[longer]]), np.concatenate([near, word[longer]])
    some = counts > 0
    columns = [pa.array(x[some], pa.int64()) for x in (ids, counts, near_n, near)]
    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_near", "n", "other"])


def _meet(batches):
    """Batches of sorted rows; the last group of a batch, which may go on, is kept for the next."""
    kept = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "s", "kind", "n", "id")]
        if kept is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(kept, rows)]
        p, s = rows[:2]
        last = int(np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))[-1])
        yield from _met(*[x[:last] for x in rows])
        kept = [x[last:] for x in rows]
    if kept is not None:
        yield from _met(*kept)


def _neighbours(pairs: DataFrame) -> DataFrame:
    """``(id, n_near, best)``: number of near words, and the one of largest count as ``(n, -id)``.

    A pair has at most the letters of the alphabet and one row, so that no task holds more than a batch of them.
    """
    order = ["p", "s", (F.col("kind") > 0), F.desc("n"), "id"]
    found = pairs.repartition("p", "s").sortWithinPartitions(*order).mapInArrow(_meet, _NEAR)
    best = F.max(F.struct("n", (-F.col("other")).alias("other")))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def _roots(steps: DataFrame) -> DataFrame:
    """``(id, root)`` of every word that has a form. Each round doubles the steps taken; n at least doubles at every step."""
    reached = stage(steps.select("id", F.col("form").alias("root")), "steps")
    while True:
        hop = reached.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stage(reached.join(hop, "root", "left").select("id", "root", "next"), "roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("id", "root")
        reached = moved.select("id", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = RATIO, range_chars: int = RANGE_CHARS) -> DataFrame:
    """The near words, form and root of each distinct word of ``words (word, n)``.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest
    ``n`` (ties: smallest in code-point order) if that is at least ``ratio`` times its own; its root is the last form that
    is reached from it, or itself. ``ratio`` is at least 2, so forms lead upwards. Returns ``(word, form, root, n, n_near,
    form_n)``. A null word is ignored, the counts of repeated words are added (null counts as 0), other columns are ignored.
    Empty in, empty out.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as its word")
    counted = words.where("word IS NOT NULL").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    counted = stage(counted, "words")
    prefixes = number_prefixes(counted, range_chars).withColumnRenamed("nodes", "prefixes")
    back = number_prefixes(counted.select(F.reverse("word").alias("word")), range_chars)
    suffixes = back.select(F.reverse("word").alias("word"), F.col("nodes").alias("suffixes"))
    known = counted.join(prefixes, "word").join(suffixes, "word").withColumn("id", F.element_at("prefixes", -1))
    known = stage(known, "nodes")
    names = known.select("id", "word", "n")
    near = stage(names.join(_neighbours(_pairs(known)), "id", "left"), "near")
    steps = near.where(F.col("best.n") >= ratio * F.col("n")).where("best.n > 0").select("id", (-F.col("best.other")).alias("form"))
    ways = steps.join(_roots(steps), "id")
    word = lambda c: names.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c), F.col("n").alias(f"{c}_n"))
    ways = ways.withColumnsRenamed({"form": "form_id", "root": "root_id"}).join(word("form"), "form_id").join(word("root"), "root_id")
    return near.join(ways, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )


def letter_runs(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """The maximal runs of at least so many letters, A to Z lower-cased; none for a null text."""
    pattern = f"{LETTERS}{{{min_chars},}}+"
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def _misspelt(word: Column, doc_id: Column) -> Column:
    """The word without one code point where the CRC-32 of document and word says so; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = docs.select("doc_id", F.explode(letter_runs(F.col("text"))).alias("run"))
    words = runs.select(_misspelt(F.col("run"), F.col("doc_id")).alias("word")).where(F.char_length("word") >= MIN_CHARS)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spelling_variants(counted.where(F.col("n") >= MIN_COUNT))
