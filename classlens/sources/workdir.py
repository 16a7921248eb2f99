"""Folder shared by all executors for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_base: list[str] = []
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in an unset local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="classlens-"))
        base = _local_base[0]
    path = f"{base.rstrip('/')}/classlens/{purpose}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


def stage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the folders that were staged inside; write results elsewhere before it ends."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
