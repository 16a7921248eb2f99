"""Writers and their readers: splits, cached results, fitted parameters, lineage, summaries."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from classlens.operators.fingerprint import fingerprint
from classlens.params import JobParams
from classlens.sources.readers import read_parquet


def write_splits_csv(splits: DataFrame, path: str) -> str:
    """CSV with a header, one folder per split; key, label and features of a row stay together."""
    if "split" not in splits.columns:
        raise ValueError("no split column: split the data first")
    splits.write.partitionBy("split").option("header", True).csv(path)
    return path


def read_splits_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read the splits back with their original schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_params(params: DataFrame, path: str) -> str:
    """Store a fitted parameter table (one row per feature)."""
    params.write.mode("overwrite").parquet(path)
    return path


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Load a fitted parameter table; a missing path is a ``FileNotFoundError``."""
    return read_parquet(spark, path)


def cache_key(df: DataFrame, params: JobParams, **arguments: object) -> str:
    """Key of a cached result: the parameters, every other argument of the job and the content of the whole input table."""
    content = fingerprint(df).select("fingerprint").first()[0]
    given = json.dumps(arguments, sort_keys=True)
    return hashlib.md5(f"{params.to_json()}|{given}|{content}".encode()).hexdigest()


_METADATA = "created_at string, config string, features string"


def save_to_cache(
    base: str, key: str, splits: DataFrame, fitted: DataFrame, params: JobParams
) -> str:
    """Write splits, fitted parameters and, last, the metadata that marks the entry as complete.

    The mark of an older entry goes first, so that a reader never takes a half-written entry for a complete one.
    """
    path = f"{base.rstrip('/')}/processed_{key}"
    spark = splits.sparkSession
    spark.createDataFrame([], _METADATA).write.mode("overwrite").json(f"{path}/metadata")
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    write_params(fitted, f"{path}/params")
    features = [r["feature"] for r in fitted.where("kept").select("feature").collect()]  # one per feature column
    row = (datetime.now(timezone.utc).isoformat(), params.to_json(), json.dumps(features))
    spark.createDataFrame([row], _METADATA).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_from_cache(
    spark: SparkSession, base: str, key: str
) -> tuple[DataFrame, DataFrame] | None:
    """``(splits, fitted parameters)`` of a complete entry, else ``None``."""
    path = f"{base.rstrip('/')}/processed_{key}"
    try:
        if spark.read.schema("created_at string").json(f"{path}/metadata").isEmpty():
            return None  # written last: without its row the entry is not complete
        return spark.read.parquet(f"{path}/splits"), spark.read.parquet(f"{path}/params")
    except AnalysisException:
        return None


def lineage(df: DataFrame, path: str, **facts: object) -> DataFrame:
    """One row: data path, content fingerprint and row count, time, and further facts as a map."""
    extra = [F.lit(str(x)) for pair in sorted(facts.items()) for x in pair]
    return fingerprint(df).select(
        F.lit(path).alias("data_path"),
        F.col("fingerprint").alias("data_hash"),
        "n_rows",
        F.lit(datetime.now(timezone.utc).isoformat()).alias("load_timestamp"),
        (F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")).alias(
            "facts"
        ),
    )


def write_lineage(row: DataFrame, path: str) -> str:
    """Append a lineage row as JSON lines."""
    row.coalesce(1).write.mode("append").json(path)
    return path


def write_summary_csv(summary: DataFrame, path: str) -> str:
    """Write a per-feature result table (one row per feature) as one CSV file with a header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
