"""The preparation job: clean, fit, scale, flag and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classlens.operators import cleaning, preparation, splitting
from classlens.operators.fingerprint import row_digest
from classlens.operators.longform import numeric_columns
from classlens.params import JobParams
from classlens.sources import sinks
from classlens.sources.workdir import stage

FIT_ON = ("all", "train")


def clean(
    df: DataFrame,
    target: str,
    key: str | None = None,
    sentinel: float = -999.0,
    include_target: bool = False,
) -> DataFrame:
    """Drop exact duplicates, then turn the sentinel into NULL, then impute medians.

    Rows that become equal only through the sentinel stay. The deduplicated table is staged once, so the
    passes after it read columns instead of repeating the shuffle.
    """
    spared = {key} if include_target else {key, target}
    columns = [c for c in numeric_columns(df) if c not in spared]
    unique = stage(cleaning.dedupe(df, key), "dedupe")
    return cleaning.median_impute(cleaning.sentinel_to_null(unique, sentinel, columns), columns)


COPY_PARTS = 64


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add md5 of the row and its number among equal rows; copies are numbered in parts, so none is hot."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(COPY_PARTS))
    rows = stage(df.select(F.struct(*df.columns).alias("row"), row_digest(df.columns).alias("d"), salt.alias("s")), "rows")
    upto = Window.partitionBy("d").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("d", "s").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("d", "s", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("d", "s").orderBy(F.lit(0)))
    number = (F.col("before") + F.col("own")).cast("string")
    return rows.withColumn("own", own).join(before, ["d", "s"]).select("row.*", F.concat_ws("|", "d", number).alias(name))


def process(
    df: DataFrame,
    params: JobParams,
    key: str | None = None,
    clean_first: bool = True,
    fit_on: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """``(splits, fitted parameters)`` of a labelled feature table.

    ``splits`` has the columns key, split, target, kept features and, if asked for, ``is_outlier``. Without
    a key column the md5 of the row as it came, and its number among equal rows, serve as ``row_key``.
    ``fit_on="train"`` fits on the training rows only.
    """
    if fit_on not in FIT_ON:
        raise ValueError(f"fit_on must be one of {FIT_ON}")
    if key is None:
        key = "row_key"
        df = df.withColumn(key, row_digest(df.columns)) if clean_first else with_row_key(df, key)
    if clean_first:
        df = clean(df, params.target, key, params.sentinel)
    prepared = preparation.prepare_features(df, params.target, key)
    features = [c for c in prepared.columns if c not in (key, params.target)]
    parted = splitting.stratified_split(
        prepared, key, params.target, params.test_size, params.seed
    )
    if fit_on == "train":  # read by every pass of the fit; the digests are not computed again for each
        parted = stage(parted, "parted")
    fitting = parted.where(F.col("split") == "train") if fit_on == "train" else prepared
    fitted = stage(
        preparation.fit(fitting, features, params.scale_method, params.variance_threshold), "fit"
    )
    threshold = params.z_thresh if params.add_outlier_flag else None
    splits = preparation.apply(parted, fitted, [key, "split", params.target], threshold)
    return splits, fitted


def process_cached(
    df: DataFrame,
    params: JobParams,
    base: str,
    key: str | None = None,
    clean_first: bool = True,
    fit_on: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """``process`` with its result stored under ``base``, keyed by all arguments and the table's content."""
    spark = df.sparkSession
    entry = sinks.cache_key(df, params, key=key, clean_first=clean_first, fit_on=fit_on)
    found = sinks.load_from_cache(spark, base, entry) if params.use_cache else None
    if found is None:
        splits, fitted = process(df, params, key, clean_first, fit_on)
        sinks.save_to_cache(base, entry, splits, fitted, params)
        found = sinks.load_from_cache(spark, base, entry)
    return found


def select_split(splits: DataFrame, name: str, as_vector: bool = False) -> DataFrame:
    """Rows of one split; with ``as_vector`` the feature columns become one array column."""
    rows = splits.where(F.col("split") == name)
    if not as_vector:
        return rows
    features = [f for f, t in rows.dtypes if t == "double"]
    return preparation.as_vector(rows, features, [c for c in rows.columns if c not in features])
