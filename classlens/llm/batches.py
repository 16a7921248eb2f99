"""Documents dealt into batches of consecutive ids, and hash parts that answer the batches.

A batch is a bounded stretch of the id order, so that comparing batch numbers compares positions. Each batch sends
every distinct hash once to the part that owns it (copies are collapsed before the shuffle), the part sees all
batches that hold the hash, and answers by batch. Batches and parts are sized by bytes and grow in number with the input.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from classlens.sources.workdir import stage

#: Text bytes of a batch; its work arrays are about eight times as large. Executors with more memory take more,
#: which keeps the number of blobs (batches times parts) low for very large corpora.
BATCH_BYTES = 8 << 20


def batch_count(docs: DataFrame, text: str, batch_bytes: int = BATCH_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / batch_bytes))


def batch_number(docs: DataFrame, key: str, n: int) -> Column:
    """Number of the stretch of ``key`` that a row lies in, by n - 1 approximate quantiles (nulls: 0)."""
    if n == 1:
        return F.lit(0)
    shares = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * n))).first()[0] or []
    if not bounds:
        return F.lit(0)
    cuts = F.lit(sorted(set(bounds)))
    size = len(set(bounds))
    steps = F.lit([1 << s for s in reversed(range(size.bit_length()))])

    def halve(low: Column, step: Column) -> Column:
        above = low + step
        return F.when((above <= size) & (F.get(cuts, above - 1) <= F.col(key)), above).otherwise(low)

    return F.aggregate(steps, F.lit(0), halve)


def dealt(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``(batch, id, text)``, one shuffle partition per batch on average.

    Numbers are cut at quantiles. Keys of other types have none; they are dealt by range and staged with their batch.
    """
    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    if n > 1 and not isinstance(chosen.schema["id"].dataType, NumericType):
        ranged = chosen.repartitionByRange(n, F.col("id").asc_nulls_first())
        return stage(ranged.withColumn("batch", F.spark_partition_id()), "ranged").repartition(n, "batch")
    return chosen.withColumn("batch", batch_number(chosen, "id", n)).repartition(n, "batch")


def in_order(table: pa.Table) -> pa.Table:
    """Rows by id, nulls first; rows of one id by text, so that reruns see the same order."""
    keys = [("id", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
