"""Feature tables that the registered queries read, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classlens.sources.readers import expand_vector, read_parquet

FEATURES = ["quantity", "price", "discount", "tax"]
DIRTY = ["quantity", "price", "discount", "tax", "void", "constant"]
WIDTH = 64
VECTOR_FEATURES = [f"feature_{i}" for i in range(WIDTH)]
ADJUSTMENTS = {
    "adjust_bonferroni": "bonferroni",
    "adjust_sidak": "sidak",
    "adjust_holm": "holm",
    "adjust_holm_sidak": "holm-sidak",
    "adjust_simes_hochberg": "simes-hochberg",
    "adjust_hommel": "hommel",
    "adjust_bh": "fdr_bh",
    "adjust_by": "fdr_by",
    "adjust_tsbh": "fdr_tsbh",
    "adjust_tsbky": "fdr_tsbky",
    "adjust_gbs": "fdr_gbs",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def item_key() -> Column:
    """Unique key of a line item: md5 of its integer columns and its price in cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.md5(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as features; class 1 is a returned item."""
    return table(spark, sf_dir, "lineitem").select(
        item_key().alias("k"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def dirty_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with sentinels, nulls, an empty and a constant column."""
    return table(spark, sf_dir, "lineitem").select(
        item_key().alias("k"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_partkey") % 97 == 0, -999.0).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.lit(None).cast("double").alias("void"),
        F.lit(1.0).alias("constant"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values, also shifted and negated; class 1 is an error event."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.col("value"),
        (F.col("value") - 20.0).alias("shifted"),
        (-F.col("value")).alias("negated"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as 64 features; class 1 is an odd label."""
    source = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") % 2).cast("int"))
    return expand_vector(source, "embedding", WIDTH, ["vec_id", "y"])


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lengths joined to their quality label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    lengths = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lengths.join(labels, "doc_id")
