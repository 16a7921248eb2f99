"""Line deduplication by an edit-distance join over segments.

A line is cut into one segment more than the edits allowed, so a line within that distance holds one of them
unchanged, near the same place. Segments are indexed by line length and place; every line probes the index with the
substrings that can match at its own and the slightly shorter lengths. Lines that meet are compared by banded
bit-parallel edit distance, and lines that are linked, directly or through others, form a class of which the
first in the corpus stays. Everything is a DataFrame expression.

Equal lines are collapsed by digest first. A line is first compared with the one that it meets most often among the
first holders of its keys; only keys that still span several classes afterwards are looked at pair by pair, between
classes and where counts of common letters, which an edit changes by two at most, allow a link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.llm.components import components
from classlens.sources.workdir import stage

EDITS = 2
#: Shorter lines are compared for equality only.
MIN_CHARS = 20
#: Lines that make up more than this share of all lines enter the index from their first place only.
HOT_SHARE = 1e-5
#: Tables of 64-bit ids are broadcast up to so many rows (about 16 MB), else joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Letters that are counted to rule out pairs: an edit changes two counts by one at most.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, t, no, line, d, e)``; no digests for lines without a word. ``t`` tells texts of one key apart."""
    split = docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("t"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line")
    )
    word = F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""
    return split.withColumn("d", F.when(word, F.xxhash64("line"))).withColumn("e", F.when(word, F.xxhash64(F.lit(1), F.col("line"))))


def segment_keys(line: Column, chars: Column, edits: int, least: int) -> Column:
    """Array of ``(k, own)``: hashes of length, segment and substring that a line probes, and whether it owns them.

    Entries of substrings that the line is too short for have no hash.

    For each length up to ``edits`` less and each segment, a substring starts where at most as many edits as there
    are segments before it, and at most as many as there are after it, have shifted it.
    """
    parts = edits + 1
    probes = [
        (shorter, i, shift)
        for shorter in range(edits + 1)
        for i in range(1, parts + 1)
        for shift in range(max(1 - i, shorter - (parts - i)), min(i - 1, shorter + parts - i) + 1)
    ]
    ascii_only, data = F.octet_length(line) == chars, line.cast("binary")  # then places are bytes and found at once

    # One small expression for all probes: written out, they make a method that is too large to be compiled.
    def key(p: Column) -> Column:
        length, i = chars - p["shorter"], p["i"]
        more = length % parts
        base = ((length - more) / parts).cast("int")
        extra = F.greatest(more - (parts - i), F.lit(0))  # longer segments stand last
        size = base + F.least(extra, F.lit(1))
        at = 1 + base * (i - 1) + F.greatest(extra - 1, F.lit(0)) + p["shift"]

        def piece(x: Column) -> Column:
            n, begin, width = x["length"], x["at"], x["size"]
            own = F.when(ascii_only, F.xxhash64(n, i, F.substring(data, begin, width)))
            found = own.otherwise(F.xxhash64(n, i, F.substring(line, begin, width)))
            return F.when((n >= least) & (begin >= 1) & (begin + width - 1 <= chars), found)

        places = F.struct(length.alias("length"), at.alias("at"), size.alias("size"))
        return F.struct(
            F.transform(F.array(places), piece)[0].alias("k"), ((p["shorter"] == 0) & (p["shift"] == 0)).alias("own")
        )

    names = ("shorter", "i", "shift")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, probe)]) for probe in probes])
    return F.transform(listed, key)


def edits_within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts of at least ``edits`` characters are within so many edits.

    The characters are bound once by folding over one element, wherever the optimiser puts the expression.
    """
    texts = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q"))
    return F.transform(F.array(texts), lambda x: _within(x["p"], x["q"], edits))[0]


def _within(a: Column, b: Column, edits: int) -> Column:
    """The same for arrays of characters, by the banded bit-parallel recurrence.

    Bit t of the band stands for place i + t - edits of the longer array when place i of the shorter one is read.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    swap = F.size(a) < F.size(b)
    one = lambda x: F.lit(x).cast("bigint")
    n = F.greatest(F.size(a), F.size(b))

    def invert(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(one(mask))

    def longer(i: Column) -> Column:
        return F.when(swap, F.get(b, i)).otherwise(F.get(a, i))

    def equal(i: Column, c: Column) -> Column:
        bits = one(0)
        for t in range(width):
            bits = bits.bitwiseOR(F.when(longer(i + (t - edits)) == c, one(1 << t)).otherwise(one(0)))
        return bits

    # Higher-order functions bind a value by folding over one element, so that it is computed once.
    def bind(value: Column, then) -> Column:
        return F.transform(F.array(value), then)[0]

    def step(s: Column, i: Column) -> Column:
        c = F.when(swap, F.get(a, i)).otherwise(F.get(b, i))

        def after(x: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            sum_ = x.bitwiseAND(vp) + vp
            zero = sum_.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(one(mask))

            def finish(d0: Column) -> Column:
                hp, hn = vn.bitwiseOR(invert(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                first = i < n - edits
                row = s["row"]
                dist = F.when(first, s["dist"] + F.when(d0.bitwiseAND(one(top)) == 0, 1).otherwise(0)).otherwise(
                    s["dist"]
                    + F.when(hp.bitwiseAND(row) != 0, 1).otherwise(0)
                    - F.when(hn.bitwiseAND(row) != 0, 1).otherwise(0)
                )
                return F.struct(
                    hn.bitwiseOR(invert(down.bitwiseOR(hp))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    dist.alias("dist"),
                    F.when(first, row).otherwise(F.shiftright(row, 1)).alias("row"),
                )

            return bind(zero, finish)

        # Once the distance cannot come back into the band nothing more is computed.
        return F.when(s["dist"] > 2 * edits, s).otherwise(bind(equal(i, c), after))

    start = F.struct(
        one((mask << edits) & mask).alias("vp"),
        one(0).alias("vn"),
        F.lit(edits).alias("dist"),
        one(top >> 1).alias("row"),
    )
    places = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1)
    return F.aggregate(places, start, step, lambda s: s["dist"] <= edits)


def _counts(line: Column) -> list[Column]:
    """How often a line holds each of the common letters."""
    return [(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x)))).alias(f"n_{x}") for x in LETTERS]


def _apart(a: str, b: str) -> Column:
    """Sum of the differences of letter counts."""
    return sum((F.abs(F.col(f"{a}.n_{x}") - F.col(f"{b}.n_{x}")) for x in LETTERS), F.lit(0))


def _links(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs of line nodes ``(a, b)`` that are within so many edits."""
    left = texts.select(F.col("node").alias("a"), F.col("line").alias("p"), F.col("chars").alias("m"), F.col("counts").alias("u"))
    right = texts.select(F.col("node").alias("b"), F.col("line").alias("q"), F.col("chars").alias("n"), F.col("counts").alias("v"))
    close = (F.abs(F.col("m") - F.col("n")) <= edits) & (_apart("u", "v") <= 2 * edits)
    both = pairs.join(left, "a").join(right, "b").where(close)
    return stage(both.where(edits_within(F.col("p"), F.col("q"), edits)).select("a", "b"), "links")


def _near_classes(docs: DataFrame, key: str, text: str, at: DataFrame, edits: int, least: int) -> DataFrame:
    """``(d, e, cd, ce)``: the digest of the class of each line that links with another one."""
    n = at.count()
    hot = at.groupBy("d").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "no")).alias("first"))
    hot = stage(hot.where(F.col("m") > max(100, n * HOT_SHARE)).select("d", "first"), "hot")
    lines = _lines(docs, key, text).withColumn("chars", F.char_length("line"))
    lines = lines.where(F.col("d").isNotNull() & (F.col("chars") >= least))
    # At most 1 / HOT_SHARE rows.
    fresh = lines.join(F.broadcast(hot), "d", "left").where(
        F.col("first").isNull() | F.struct("key", "no").eqNullSafe(F.col("first"))
    )
    keys = fresh.select("d", F.inline(segment_keys(F.col("line"), F.col("chars"), edits, least)))
    keys = keys.where("k IS NOT NULL").repartition("k")
    several = keys.groupBy("k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("own").alias("some"))
    several = several.where("some AND lo <> hi").select("k")  # from the same exchange as the rows themselves
    # Few keys are held by several lines: a hash table of them per partition spares the sort of all rows.
    met = keys.join(several.hint("shuffle_hash"), "k").groupBy("k", "d").agg(F.max("own").alias("own"))
    met = stage(met, "met")

    wanted = stage(met.select("d").distinct(), "wanted")
    texts = lines.join(_sized(wanted), "d", "left_semi").select("d", "e", "line").groupBy("d", "e").agg(F.min("line").alias("line"))
    texts = texts.select("d", "e", "line", F.char_length("line").alias("chars"), F.struct(*_counts(F.col("line"))).alias("counts"))
    texts = stage(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    held = stage(met.join(texts.select("d", "node", "chars", "counts"), "d").drop("d"), "held")
    ends = held.groupBy("k").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("o"), F.min("node").alias("p"))
    starred = held.join(ends.where("o IS NOT NULL"), "k")
    pairs = starred.select(F.col("node").alias("a"), F.col("o").alias("b")).unionByName(
        starred.where("own").select(F.col("node").alias("a"), F.col("p").alias("b"))
    )
    pairs = pairs.where("a <> b").groupBy("a", "b").count().groupBy("a").agg(F.max(F.struct("count", -F.col("b"))).alias("m"))
    first = _links(pairs.select("a", (-F.col("m.col2")).alias("b")), texts, edits)
    near = stage(components(first), "near")
    named = held.join(near, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    named = stage(named, "grouped")
    split = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("own").alias("some"))
    open_ = stage(named.join(split.where("some AND lo <> hi").select("k"), "k"), "open")
    own = open_.where("own").select("k", F.col("node").alias("a"), F.col("c").alias("g"), F.col("chars").alias("m"), F.col("counts").alias("u"))
    other = open_.select("k", F.col("node").alias("b"), F.col("c").alias("h"), F.col("chars").alias("n"), F.col("counts").alias("v"))
    allowed = (own["k"] == other["k"]) & (F.col("g") != F.col("h")) & (F.abs(F.col("m") - F.col("n")) <= edits)
    pairs = own.join(other, allowed & (_apart("u", "v") <= 2 * edits)).select("a", "b")
    second = _links(_distinct(pairs), texts, edits)

    found = stage(components(first.unionByName(second)), "classes")
    named = texts.select("d", "e", "node").join(found, "node")
    heads = named.where("node = component").select("component", F.col("d").alias("cd"), F.col("e").alias("ce"))
    return stage(named.join(heads, "component").select("d", "e", "cd", "ce"), "named")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``(key, t, no, cd, ce, lines, stays)`` for every line; one without a word has no class and stays.

    ``t`` is a hash of the text, ``no`` the line's place in it from 0, ``(cd, ce)`` names the class of lines that equal
    it or are linked with it by chains of at most ``edits`` edits (lines of at least ``min_chars`` characters), ``lines``
    counts the class, and the first line of a class by (key, place) stays. Rows repeated in full are one document.
    """
    if min_chars <= 2 * edits:
        raise ValueError("lines that are compared need more than twice as many characters as edits")
    at = stage(_lines(docs, key, text).select("key", "t", "no", "d", "e").distinct(), "lines")
    blank = at.where("d IS NULL").select("key", "t", "no", F.lit(None).cast("bigint").alias("cd"))
    blank = blank.select("*", F.col("cd").alias("ce"), F.col("cd").alias("lines"), F.lit(True).alias("stays"))
    at = at.where("d IS NOT NULL")
    named = _near_classes(docs, key, text, at, edits, min_chars)
    at = at.join(named, ["d", "e"], "left").select(
        "key", "t", "no", F.coalesce("cd", "d").alias("cd"), F.coalesce("ce", "e").alias("ce")
    )
    at = stage(at, "classed")
    place = F.struct("key", "no", "t")
    heads = at.groupBy("cd", "ce").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("lines"))
    found = at.join(heads, ["cd", "ce"]).withColumn("stays", place.eqNullSafe(F.col("first")))
    return found.select(*blank.columns).unionByName(blank)


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents without the lines that equal or nearly equal an earlier line of the corpus.

    Returns one row per row: ``doc`` (the row as it came), ``n_lines`` (lines with a word), ``n_removed`` and
    ``kept_text``; lines without a word stay. A null text stays null and has no lines. Lines are ordered by key (null
    first), place and text hash; rows repeated in full share their fate. Columns may have any names. Empty in, empty out.
    """
    entry = F.struct("no", "stays", F.col("cd").isNotNull().alias("word"))
    marks = line_classes(docs, key, text, **options).groupBy("key", "t").agg(
        F.sort_array(F.collect_list(entry)).alias("marks")  # the lines of one document
    )
    marks = marks.select(
        F.col("key").alias("_key"),
        F.col("t").alias("_t"),
        F.size(F.filter("marks", lambda m: m["word"])).alias("n_lines"),
        F.size(F.filter("marks", lambda m: ~m["stays"])).alias("n_removed"),
        F.transform("marks", lambda m: m["stays"]).alias("stays"),
    )
    marks = stage(marks.withColumn("stays", F.when(F.col("n_removed") > 0, F.col("stays"))), "marks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("t", F.xxhash64(f"doc.{text}"))
    joined = whole.join(marks, F.col(f"doc.{key}").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t")), "left")
    kept = F.array_join(F.filter(F.split(f"doc.{text}", "\n"), lambda x, i: F.get(F.col("stays"), i)), "\n")
    return joined.select(
        "doc",
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("stays").isNull(), F.col(f"doc.{text}")).otherwise(kept).alias("kept_text"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    return drop_lines(docs).select("doc.doc_id", "n_lines", "n_removed", sha)
