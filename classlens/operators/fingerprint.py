"""Content fingerprint of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(columns: Sequence[str]) -> Column:
    """md5 of a row's cells, each as its length and text, or as ``N`` when missing."""
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        cells.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("N")))
    return F.md5(F.concat_ws("|", *cells))


def fingerprint(
    df: DataFrame, columns: Sequence[str] | None = None, index: str | None = None
) -> DataFrame:
    """One row ``(n_rows, digest_sum, digest_xor, fingerprint)`` over all rows.

    A moved null or separator changes the digest of its row. Row digests are combined by sum and
    exclusive or, which needs no row order; name an ``index`` column to make the result depend on the
    order too.
    """
    chosen = list(columns or [c for c in df.columns if c != index])
    digest = row_digest([*chosen, *([index] if index else [])])
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    sums = df.select(number.alias("d")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("d").cast("decimal(38,0)")).cast("string").alias("digest_sum"),
        F.bit_xor("d").cast("string").alias("digest_xor"),
    )
    return sums.withColumn(
        "fingerprint",
        F.md5(F.concat_ws("|", F.col("n_rows").cast("string"), "digest_sum", "digest_xor")),
    )
