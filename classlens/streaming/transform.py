"""Fitted scaling on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from classlens.operators.preparation import apply


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def transform_stream(
    stream: DataFrame,
    params: DataFrame,
    keep: Sequence[str] = (),
    outlier_threshold: float | None = None,
) -> DataFrame:
    """Scale a streaming frame with fitted parameters: map-only, so it holds no state."""
    return apply(stream, params, keep, outlier_threshold)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the checkpoint makes a restart go on where it ended."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
