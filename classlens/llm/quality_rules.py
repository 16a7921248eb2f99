"""Quality rules whose thresholds come from the documents themselves.

Three shares of each text (symbols per word character, repeated lines, words in repeated windows) are summarised by
KLL quantile sketches per language and source. A threshold is a fence above the upper quartile of the group. Sketches
of small groups merge into the one of their language, and those of small languages into the one of all
documents, so no document is judged by a handful of others. The thresholds, one row per group, are joined to the
documents. The text is read once; nothing but sketches and group rows is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.llm.words import words
from classlens.sources.workdir import stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Values up to this number are kept as they are by a sketch; beyond, ranks are off by about 0.1 %.
SKETCH_K = 4096
#: Rows that a group needs for thresholds of its own.
MIN_ROWS = 50
#: A fence lies this many spreads above the upper quartile; the spread is the distance of the quartiles, or the
#: least spread of the measure where most texts have the same value.
REACH = 3.0
MEASURES = {"symbols": 0.01, "lines": 0.15, "repeats": 0.09}
#: The table of thresholds is broadcast up to so many groups (about 100 bytes each), else joined by shuffle.
BROADCAST_GROUPS = 100_000


def _symbols(text: Column) -> Column:
    without = reduce(lambda t, s: F.replace(t, F.lit(s)), SYMBOLS, text)
    return (F.octet_length(text) - F.octet_length(without)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _window_hashes(w: Column) -> Column:
    n = F.size(w) - (WINDOW - 1)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))


def _ordered(w: Column, hashes: Column) -> Column:
    """Windows by hash, in texts in which a hash occurs twice; null in the others."""
    row = lambda h, i: F.struct(
        h.alias("h"), F.hash(F.slice(w, i + 1, WINDOW)).alias("g"), i.alias("i")
    )
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(hashes.isNotNull() & some, F.sort_array(F.transform(hashes, row)))


def _places(ordered: Column) -> Column:
    """First words of the windows that occur twice, in order; ``ordered`` has to be a column."""

    def same(x: Column, i: Column) -> Column:
        other = F.get(ordered, i)
        return F.coalesce((x["h"] == other["h"]) & (x["g"] == other["g"]), F.lit(False))

    twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    count = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.coalesce(count, F.lit(0)).cast("bigint")


def measured(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(doc, lang, source, counts..., base_failed, symbols, lines, repeats)``; ``doc`` holds the row as it is."""
    whole = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    lines = F.col("_lines")
    out = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        .withColumn("_words", words(F.col(f"doc.{text}")))
        .withColumn("_lines", _lines(whole))
        .withColumn("_hashes", _window_hashes(F.col("_words")))
        .withColumn("_ordered", _ordered(F.col("_words"), F.col("_hashes")))
    )
    out = out.select(
        "doc",
        F.col(f"doc.{lang}").alias("lang"),
        F.col(f"doc.{source}").alias("source"),
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        _symbols(whole).alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _covered(_places(F.col("_ordered"))).alias("n_repeat_words"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return out.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_dup_lines", "n_lines").alias("lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """``(lang, source, max_symbols, max_lines, max_repeats)`` for each language and source."""
    sketch = [F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    merge = [F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    leaves = stage(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *sketch), "sketches")
    total = F.sum("n").alias("n")

    def named(df: DataFrame, level: str) -> DataFrame:
        return df.select(*[c for c in ("lang", "source") if c in df.columns], F.struct("n", *MEASURES).alias(level))

    every = named(leaves.agg(total, *merge), "every").withColumn("one", F.lit(1))
    langs = named(leaves.groupBy("lang").agg(total, *merge), "by_lang").withColumnRenamed("lang", "_lang")
    own = named(leaves, "own")
    joined = own.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("one", F.lit(1)).join(every, "one")
    used = F.when(F.col("own.n") >= MIN_ROWS, F.col("own")).when(F.col("by_lang.n") >= MIN_ROWS, F.col("by_lang"))
    joined = joined.select("lang", "source", used.otherwise(F.col("every")).alias("s"))

    def fence(m: str, least: float) -> Column:
        low, high = (F.kll_sketch_get_quantile_double(f"s.{m}", F.lit(q)) for q in (0.25, 0.75))
        return (high + REACH * F.greatest(high - low, F.lit(least))).alias(f"max_{m}")

    return joined.select("lang", "source", *[fence(m, least) for m, least in MEASURES.items()])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Measure every document and compare it with the thresholds of its language and source.

    Returns one row per row: ``doc`` (the row as it came, whatever its columns are called), ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, the three shares, their
    thresholds ``max_*`` and ``kept``. A document is kept if it passes the base rule (20 words, at most 30 % of them
    in repeated windows) and no share is above its threshold. A null text counts as empty and fails the base rule.
    Null languages and sources form groups of their own. Empty in, empty out.
    """
    rows = stage(measured(docs, text, lang, source), "measured")
    limits = stage(thresholds(rows), "thresholds")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    limits = limits.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    within = reduce(lambda a, b: a & b, [F.col(m) <= F.col(f"max_{m}") for m in MEASURES])
    return rows.join(limits, same).drop("_lang", "_source").withColumn("kept", ~F.col("base_failed") & within)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select("doc.doc_id", *counts)
