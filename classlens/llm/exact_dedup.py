"""Exact deduplication by naming blocks: equal texts get one integer name, different texts never do.

A text, lower-cased from A to Z, is cut into blocks of a fixed number of bytes. The distinct blocks of the corpus
are sorted and numbered; then adjacent pairs of names are sorted and numbered, and so on, until each document has
one name. Two documents are equal exactly when they have equally many blocks and the same last name, whatever the
hashes do: names come from the blocks themselves. Distinct blocks are collapsed before the shuffle, so blocks that
many documents share travel once per task. The way back from a block to its name is a join on a 128-bit digest of
the block, after a check that no two distinct blocks share a digest; if some do, the join compares the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classlens.sources.workdir import stage

BLOCK_BYTES = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z alone; ``lower`` does the same on texts that are all ASCII, and is faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _blocks(text: Column, size: int) -> Column:
    """The text's bytes in blocks of ``size``; an empty text is one empty block."""
    data = text.cast("binary")
    last = F.greatest((F.octet_length(text) - 1) / size, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _digest(block: Column) -> list[Column]:
    return [F.xxhash64(block).alias("d"), F.xxhash64(F.lit(1), block).alias("e")]


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names by order: rows are sorted inside their hash partition and numbered from there.

    Distinct rows have one sorted order, so a task that runs again gives the same names; the result is staged.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, key, n_blocks, name, text_sha256)``; ``row`` numbers the rows, ``(n_blocks, name)`` is the identity."""
    text_of = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    lowered = docs.select(F.col(key).alias("key"), text_of.alias("text"))
    blocks = lowered.select("key", F.sha2("text", 256).alias("sha"), _blocks(F.col("text"), block_bytes).alias("blocks"))
    distinct = blocks.select(F.explode("blocks").alias("block")).select(*_digest(F.col("block")), "block").distinct()
    names = stage(_numbered(distinct, "d", "e", "block").drop("block"), "names")
    on = ["d", "e"]
    clash = not names.groupBy(*on).count().where("count > 1").isEmpty()
    if clash:
        names, on = stage(_numbered(distinct, "d", "e", "block"), "names"), ["d", "e", "block"]
    parts = stage(
        blocks.select(
            F.monotonically_increasing_id().alias("row"),
            "key",
            "sha",
            F.transform("blocks", lambda b: F.struct(*_digest(b), *[b.alias("block")] * clash)).alias("at"),
        ),
        "digests",
    )
    rows = parts.select("row", F.size("at").alias("n"), F.posexplode("at").alias("i", "at"))
    named = rows.select("row", "n", "i", "at.*").join(names, on).select("row", "n", "i", "name")
    done, level = None, stage(named, "level")
    while True:
        last = level.where("n = 1").select("row", "name")
        done = last if done is None else done.unionByName(last)
        more = level.where("n > 1")
        if more.isEmpty():
            break
        pairs = more.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("i", 1).alias("j")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = stage(pairs, "pairs")
        names = stage(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "names")
        level = stage(pairs.join(names, ["a", "b"]).select("row", "n", F.col("j").alias("i"), "name"), "level")
    sizes = parts.select("row", "key", F.size("at").alias("n_blocks"), F.col("sha").alias("text_sha256"))
    return sizes.join(done, "row")


def drop_equal(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which rows stay when texts that are equal but for the case of A to Z are merged.

    Returns ``(key, keep_id, group_size, kept, text_sha256)`` for every row. The largest key of a group stays; of
    rows that share it one stays. A null text counts as empty, a null key as smaller than any other; the row of a
    group without any key stays by the same rule. Other columns are ignored. Empty in, empty out.
    """
    named = stage(name_documents(docs, key, text, block_bytes), "identity")
    identity = ["n_blocks", "name"]
    best = F.max(F.struct("key", "row"))
    groups = stage(named.groupBy(*identity).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, identity).select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_equal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
