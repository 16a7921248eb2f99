"""Connected components of an edge table, by alternating stars over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.sources.workdir import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or its smaller) neighbours to its smallest one."""
    near = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = near.join(least, "a").where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        tied = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; a component is its smallest node.

    Large and small stars alternate until the edges stay the same. The number of rounds grows with the logarithm of the
    longest path. Counts of a node's neighbours are collapsed before the shuffle; joins on a hot node are split by
    adaptive execution. Only one number per round reaches the driver.
    """
    def marked(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = marked(now)
    while True:
        now = stage(_star(_star(now, True), False), "edges")
        mark = marked(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
