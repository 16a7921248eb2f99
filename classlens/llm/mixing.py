"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document is taken in as many whole copies as its source's target
holds the source in full; the rest of the target is a Pareto sample of fixed size with unequal inclusion: a document's
probability grows with its words, so that the expected words are the rest; documents that would pass one are
certain, and the others share what is left. Documents are ranked by the odds of a random number over the odds of their
inclusion, and the first ones that fill the rest are taken. The random number is a digest of key and seed, so reruns agree. Where the ranking is cut is found from sums per rank bucket, and only the
bucket that holds the cut is ranked row by row; the outcome is one row per source, joined to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classlens.llm.words import n_words
from classlens.sources.workdir import stage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 20240601
#: Buckets of the ranking of a source; one of them is ranked row by row.
BUCKETS = 1 << 14
#: The table of sources is broadcast up to so many rows (about 100 bytes each), else joined by shuffle.
BROADCAST_SOURCES = 100_000


def uniform(key: Column, seed: int) -> Column:
    """Number inside (0, 1) from the first 52 bits of a digest of key and seed."""
    hexed = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources by code point, nulls last, take the weights in turn and share all words. No target exceeds
    ``max_copies`` times its source; the excess is shared out by weight again, which has a closed form: ordered by
    capacity per weight, a source is full as long as that is below the level of those after it.
    """
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", w).withColumn("most", (F.lit(max_copies) * F.col("source_size")).cast("bigint"))
    order = Window.orderBy(F.col("most") / F.col("w"), "n")
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum("source_size").over(every) - full) / left)
    holds = F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct(F.col("most") / F.col("w"), "n", "level"))
    common = F.min(holds).over(every)["level"]
    return level.withColumn("common", common).select(
        "source",
        "source_size",
        F.least(F.col("most").cast("double"), F.col("w") * F.col("common")).alias("target"),
    )


def _cut_points(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: whole copies and the last place of the ranking that is taken once more.

    ``rows``: ``(key, source, size, u)``. Places are compared as (bucket, odds, key); rows of one key and size are taken
    together, and a unit is taken while more than half of it is needed.
    """
    small = plan.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    placed = rows.join(_sized(small), same).where("rest > 0")
    placed = placed.withColumn("odds", pareto_odds(F.col("u"), _inclusion(F.col("size")))).withColumn("bucket", bucket(F.col("odds")))
    sums = placed.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    reached = stage(
        sums.withColumn("before", F.sum("size").over(upto) - F.col("size"))
        .where("before < rest AND before + size >= rest")
        .select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before"),
        "reached",
    )
    same = F.col("source").eqNullSafe(F.col("_at"))
    inside = placed.join(_sized(reached.withColumnRenamed("_source", "_at")), same & (F.col("bucket") == F.col("_bucket")))
    units = inside.groupBy("source", "bucket", "odds", "key", "rest", "before").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("odds", F.col("key").asc_nulls_first()))
    taken = units.withColumn("half", F.col("before") + running - F.col("size") / 2).where("half <= rest")
    last = taken.groupBy(F.col("source").alias("_taken")).agg(F.max(F.struct("odds", "key")).alias("last"))
    cuts = reached.join(last, F.col("_source").eqNullSafe(F.col("_taken")), "left").drop("_taken")
    out = plan.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "before")
    return out.withColumnRenamed("_bucket", "cut")


def _scales(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``scale``, the inclusion probability per word, so that ``min(1, scale * size) * size`` sums to the rest.

    Ordered by size, the largest documents are certain as long as the scale that the others would need takes them beyond
    one. Rows of one size collapse first; a source has no more of them than its longest document has words.
    """
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("m")).where("size > 0")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    words, squares = F.col("m") * F.col("size"), (F.col("m") * F.col("size")).cast("decimal(38,0)") * F.col("size")
    sums = counts.select(
        F.col("source").alias("_source"),
        "size",
        F.coalesce(F.sum(words).over(larger), F.lit(0)).alias("certain"),
        F.sum(squares).over(others).cast("double").alias("squares"),
    )
    need = (F.col("rest") - F.col("certain")) / F.col("squares")
    known = plan.join(sums, F.col("source").eqNullSafe(F.col("_source"))).where("rest > 0")
    known = known.withColumn("need", need).where(F.col("need") * F.col("size") <= 1)
    scale = known.groupBy("_source").agg(F.max(F.struct("size", "need"))["need"].alias("scale"))
    out = plan.join(scale, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return out.withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def _inclusion(size: Column) -> Column:
    return F.least(F.col("scale") * size, F.lit(1.0))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def pareto_odds(u: Column, inclusion: Column) -> Column:
    """Rank of a document in the sample: odds of the random number over odds of its inclusion."""
    inside = F.least(F.greatest(inclusion, F.lit(1e-12)), F.lit(1 - 1e-12))
    return (u / (1 - u)) / (inside / (1 - inside))


def bucket(odds: Column) -> Column:
    return F.least(F.floor(odds / (1 + odds) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Callable[[str], Column] = lambda doc: n_words(F.col(f"{doc}.text")),
    weights: Sequence[float] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """How often each document is taken so that sources reach their target shares of all words.

    ``size`` gives the words of a row from the name of the struct that holds it.

    Returns one row per row: ``doc`` (the row as it came), ``size``, ``source_size``, ``target`` and ``copies``
    (0 to ``max_copies``). A null or blank text has size 0; a null source is a source of its own, the last one. Rows that
    share key and size share their fate. A document without words is never sampled. An empty table gives no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = whole.select(
        F.col(f"doc.{key}").alias("key"), F.col(f"doc.{source}").alias("source"), size("doc").alias("size")
    )
    rows = stage(rows.withColumn("u", uniform(F.col("key"), seed)), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    plan = targets(sizes, weights, max_copies).withColumn("whole", F.floor(copies).cast("int"))
    rest = F.least(F.col("target") - F.col("whole") * F.col("source_size"), F.col("source_size"))
    plan = stage(plan.withColumn("rest", rest), "targets")
    plan = stage(_scales(rows, plan), "scales")
    cuts = stage(_cut_points(rows, plan), "cuts").withColumnRenamed("source", "_source")
    same = F.col(f"doc.{source}").eqNullSafe(F.col("_source"))
    out = whole.join(_sized(cuts), same).withColumn("u", uniform(F.col(f"doc.{key}"), seed)).withColumn("size", size("doc"))
    out = out.withColumn("odds", pareto_odds(F.col("u"), _inclusion(F.col("size"))))
    place = F.struct(F.col("odds"), F.col(f"doc.{key}").alias("key"))
    at = bucket(F.col("odds"))
    more = F.when(F.col("cut").isNull() | (F.col("rest") <= 0), False).otherwise(
        (at < F.col("cut")) | ((at == F.col("cut")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    )
    return out.select(
        "doc",
        "size",
        "source_size",
        "target",
        (F.col("whole") + more.cast("int")).alias("copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    return mix(docs, **options).select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")).select("doc.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "words")
    taken = (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    out = mix(sizes, size=lambda doc: F.col(f"{doc}.size"))
    return out.select("doc.doc_id", "size", "source_size", "target", taken)
