"""Feature table readers: width check, positional names, row numbers and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from classlens.params import JobParams
from classlens.sources.workdir import stage


def _missing_path(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def read_csv(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """Read a CSV file with a header as doubles; only the header is looked at to find the width."""
    try:
        header = spark.read.csv(path, header=True)
    except AnalysisException as error:
        if _missing_path(error):
            raise FileNotFoundError(f"data file not found: {path}") from error
        raise
    if n_features is not None:
        check_width(header, n_features)
    schema = StructType([StructField(c, DoubleType(), True) for c in header.columns])
    return spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table; a missing path is a ``FileNotFoundError``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if _missing_path(error):
            raise FileNotFoundError(f"data file not found: {path}") from error
        raise


def check_width(df: DataFrame, expected: int) -> DataFrame:
    """Raise unless the table has exactly ``expected`` columns; reads no data."""
    if len(df.columns) != expected:
        raise ValueError(f"expected {expected} columns, got {len(df.columns)}")
    return df


def rename_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rename columns by position to ``feature_0``, ``feature_1``, ..."""
    chosen = list(columns or df.columns)
    return df.select(*[F.col(c).alias(f"feature_{i}") for i, c in enumerate(chosen)])


def expand_vector(
    df: DataFrame, column: str, width: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Array column to ``feature_0 ... feature_{width-1}`` as double."""
    return df.select(
        *keep, *[F.col(column)[i].cast("double").alias(f"feature_{i}") for i in range(width)]
    )


BROADCAST_BLOCKS = 200_000
BLOCK_PARTS = 64


def _located(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the file (and block) of each row and its position in reading order, as ``_read``.

    Parquet knows the position inside the file. Rows of a CSV block are read one after the other by one
    task, so their running ids are consecutive. How files are cut into blocks depends on the session and
    its executors, so the rows are staged with their place and only read from there.
    """
    known = df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    file = F.col("_metadata.file_path").alias("_file")
    if "row_index" in known:
        return df.select("*", file, F.col("_metadata.row_index").alias("_read")), ["_file"]
    block = F.col("_metadata.file_block_start").alias("_block")
    read = F.monotonically_increasing_id().alias("_read")
    return stage(df.select("*", file, block, read), "located"), ["_file", "_block"]


def _blocks(located: DataFrame, place: list[str]) -> DataFrame:
    """``(*place, first, rows, before)``: one row per file or block, with the rows of earlier ones.

    Blocks are dealt in order over a fixed number of parts; sums of whole parts go over the driver.
    """
    counts = located.groupBy(*place).agg(F.min("_read").alias("first"), F.count(F.lit(1)).alias("rows"))
    parted = counts.repartitionByRange(BLOCK_PARTS, *place).withColumn("_part", F.spark_partition_id())
    parted = stage(parted, "blocks")
    sums = {r["_part"]: r["n"] for r in parted.groupBy("_part").agg(F.sum("rows").alias("n")).collect()}
    earlier = F.lit(0).cast("bigint")
    for part in sums:
        before = sum(n for p, n in sums.items() if p < part)
        earlier = F.when(F.col("_part") == part, F.lit(before).cast("bigint")).otherwise(earlier)
    upto = Window.partitionBy("_part").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("rows").over(upto), F.lit(0))
    return parted.withColumn("before", earlier + inside).drop("_part")


def with_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Add the 0-based position of each row of a CSV or Parquet table, files in path order.

    A position is the rows of earlier files or blocks plus the position inside. The rows themselves are
    not shuffled while the block table is small enough to broadcast.
    """
    located, place = _located(df)
    blocks = stage(_blocks(located, place), "blocks")
    offsets = blocks.select(*place, (F.col("before") - F.col("first")).alias("_offset"))
    if blocks.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    unknown = F.raise_error(F.lit("a row of a file or block that was not counted")).cast("bigint")
    number = F.coalesce(F.col("_offset") + F.col("_read"), unknown)
    return located.join(offsets, place, "left").select(*df.columns, number.alias(name))


def label_first_rows(
    df: DataFrame, n_signal: int, target: str = "signal", index: str | None = None
) -> DataFrame:
    """Label the first ``n_signal`` rows 1 and the rest 0, by file order or by an index column.

    In file order only the block in which the count is reached has to be known: rows before it are
    signal, rows after it are not, and rows in it are compared by position.
    """
    if index:
        return df.withColumn(target, (F.col(index) < n_signal).cast("int"))
    located, place = _located(df)
    reached = (F.col("before") <= n_signal) & (n_signal < F.col("before") + F.col("rows"))
    last = _blocks(located, place).where(reached).first()
    if last is None:
        return df.withColumn(target, F.lit(1))
    own = F.struct(*place)
    limit = F.struct(*[F.lit(last[c]).alias(c) for c in place])
    inside = F.col("_read") < last["first"] + n_signal - last["before"]
    flag = F.when(own < limit, 1).when((own == limit) & inside, 1).otherwise(0)
    return located.select(*df.columns, flag.alias(target))


def load_features(spark: SparkSession, path: str, params: JobParams) -> DataFrame:
    """CSV file to a labelled feature table: width check, positional names, label by row order."""
    raw = read_csv(spark, path, params.n_features)
    numbered = with_row_number(raw, "row_number")
    named = numbered.toDF(*[f"feature_{i}" for i in range(params.n_features)], "row_number")
    return label_first_rows(named, params.number_of_signals, params.target, "row_number")
