"""Registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classlens.operators import (
    cleaning,
    correlation,
    density,
    histogram,
    multitest,
    neighbours,
    preparation,
    profiling,
    projection,
    resampling,
    splitting,
    twoclass,
)
from classlens.operators.fingerprint import fingerprint
from classlens.operators.ranked import rank_statistics, ranked_values
from classlens.params import JobParams
from classlens.plans.inputs import (
    ADJUSTMENTS,
    DIRTY,
    FEATURES,
    VECTOR_FEATURES,
    dirty_items,
    events,
    items,
    labelled_documents,
    table,
    vectors,
)
from classlens.plans.process import clean, process, process_cached, select_split
from classlens.plans.separation import separation_summary
from classlens.sources import readers, sinks
from classlens.sources.workdir import shared_folder, stage
from classlens.streaming import transform as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42
N_BOOT = 1000


def register(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def rounded(frame: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round the double columns so that summation order does not show."""
    return frame.select(
        *[
            F.round(F.col(f), special.get(f, digits)).alias(f) if t == "double" else F.col(f)
            for f, t in frame.dtypes
        ]
    )


def joined_vector(column: str) -> Column:
    """An array of doubles as text, in millionths."""
    return F.array_join(
        F.transform(column, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), ","
    )


# ---------------------------------------------------------------- sources and sinks


@register("scan_features")
def scan_features(spark, sf):
    return items(spark, sf)


@register("rename_features")
def rename_features(spark, sf):
    part = table(spark, sf, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return readers.rename_features(readers.check_width(part.select(*columns), len(columns)))


@register("expand_vector")
def expand_vector(spark, sf):
    return vectors(spark, sf)


@register("label_first_n")
def label_first_n(spark, sf):
    numbered = readers.with_row_number(table(spark, sf, "lineitem"), "row_number")
    labelled = readers.label_first_rows(numbered, 2500, "signal", "row_number")
    return labelled.select("row_number", "l_orderkey", "l_partkey", "signal")


@register("label_first_n_by_file")
def label_first_n_by_file(spark, sf):
    labelled = readers.label_first_rows(table(spark, sf, "lineitem"), 2500)
    return labelled.select("l_orderkey", "l_partkey", "l_extendedprice", "signal")


@register("label_first_n_csv")
def label_first_n_csv(spark, sf):
    path = shared_folder(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(
        4, "o_orderkey"
    ).sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    params = JobParams(n_features=2, number_of_signals=500)
    loaded = readers.load_features(spark, path, params)
    return loaded.withColumn("row_number", F.col("row_number").cast("bigint"))


@register("class_count_check")
def class_count_check(spark, sf):
    params = JobParams(number_of_signals=20_000, number_of_background=40_000)
    return profiling.class_count_check(
        items(spark, sf), "y", params.number_of_signals, params.number_of_background
    )


@register("splits_csv_roundtrip")
def splits_csv_roundtrip(spark, sf):
    splits = splitting.stratified_split(items(spark, sf), "k", "y", 0.2, SEED)
    path = sinks.write_splits_csv(splits, shared_folder(spark, "splits-csv"))
    return sinks.read_splits_csv(spark, path, splits.schema)


@register("cache_roundtrip")
def cache_roundtrip(spark, sf):
    params = JobParams(target="y", scale_method="robust")
    source = items(spark, sf)
    base = shared_folder(spark, "cache")
    process_cached(source, params, base, "k")
    splits, _ = process_cached(source, params, base, "k")
    return rounded(splits.select("k", F.col("split").cast("string"), "y", *FEATURES, "is_outlier"))


@register("params_roundtrip")
def params_roundtrip(spark, sf):
    fitted = preparation.fit(items(spark, sf), FEATURES)
    path = sinks.write_params(fitted, shared_folder(spark, "params"))
    loaded = sinks.read_params(spark, path)
    return rounded(loaded.select("feature", "ordinal", "center", "scale", "kept"), 7)


@register("lineage")
def lineage(spark, sf):
    source = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    row = sinks.lineage(source, f"{sf}/lineitem.parquet", clean=False)
    path = sinks.write_lineage(row, shared_folder(spark, "lineage"))
    loaded = spark.read.schema(row.schema).json(path)
    return loaded.select("data_hash", "n_rows", F.col("facts")["clean"].alias("clean"))


@register("lineage_all")
def lineage_all(spark, sf):
    row = sinks.lineage(table(spark, sf, "lineitem"), f"{sf}/lineitem.parquet", clean=False)
    path = sinks.write_lineage(row, shared_folder(spark, "lineage"))
    loaded = spark.read.schema(row.schema).json(path)
    return loaded.select("data_hash", "n_rows", F.col("facts")["clean"].alias("clean"))


# ---------------------------------------------------------------- cleaning and profiling


@register("dedupe_rows")
def dedupe_rows(spark, sf):
    return cleaning.dedupe(items(spark, sf).select("quantity", "discount", "tax", "y"))


@register("dedupe_keyed")
def dedupe_keyed(spark, sf):
    return cleaning.dedupe(items(spark, sf).select("k", "quantity", "discount", "tax", "y"), "k")


@register("dedupe_rows_all")
def dedupe_rows_all(spark, sf):
    return cleaning.dedupe(items(spark, sf).select(*FEATURES, "y"))


@register("dedupe_keyed_all")
def dedupe_keyed_all(spark, sf):
    return cleaning.dedupe(items(spark, sf).select("k", *FEATURES, "y"), "k")


@register("sentinel_to_null")
def sentinel_to_null(spark, sf):
    return cleaning.sentinel_to_null(dirty_items(spark, sf)).select("k", *DIRTY)


@register("sentinel_counts")
def sentinel_counts(spark, sf):
    return cleaning.sentinel_counts(dirty_items(spark, sf))


@register("missing_summary")
def missing_summary(spark, sf):
    return cleaning.missing_summary(cleaning.sentinel_to_null(dirty_items(spark, sf)))


@register("median_impute")
def median_impute(spark, sf):
    nulled = cleaning.sentinel_to_null(dirty_items(spark, sf))
    return rounded(cleaning.median_impute(nulled, ["quantity", "price"]).select("k", "quantity", "price"))


@register("impute_all_null")
def impute_all_null(spark, sf):
    nulled = cleaning.sentinel_to_null(dirty_items(spark, sf))
    return rounded(cleaning.median_impute(nulled, DIRTY).select("k", "void", "constant"))


@register("clean_full")
def clean_full(spark, sf):
    source = dirty_items(spark, sf).select("y", "quantity", "discount", "tax", "void", "constant")
    return rounded(clean(source, "y"))


@register("clean_full_all")
def clean_full_all(spark, sf):
    return rounded(clean(dirty_items(spark, sf).select("y", *DIRTY), "y"))


@register("profile_features")
def profile_features(spark, sf):
    source = items(spark, sf).withColumn("balance", F.col("price") - 50000.0)
    profile = profiling.profile_features(source, [*FEATURES, "balance"])
    return rounded(profile, dynamic_range=3)


@register("profile_events")
def profile_events(spark, sf):
    profile = profiling.profile_features(events(spark, sf), ["value", "shifted", "negated"])
    return rounded(profile, dynamic_range=3)


@register("scaling_recommendation")
def scaling_recommendation(spark, sf):
    profile = profiling.profile_features(events(spark, sf), ["value", "shifted", "negated"])
    return profile.select("feature", "recommended_scale")


@register("scaling_summary")
def scaling_summary(spark, sf):
    features = ["value", "shifted", "negated"]
    summary = profiling.scaling_summary(profiling.profile_features(events(spark, sf), features))
    return summary.select(
        "recommended_scale",
        "n_features",
        F.array_join(F.transform("examples", lambda e: e["feature"]), ",").alias("examples"),
    )


@register("data_summary")
def data_summary(spark, sf):
    source = cleaning.sentinel_to_null(dirty_items(spark, sf)).drop("k")
    return rounded(profiling.data_summary(source, "y"))


@register("class_distribution")
def class_distribution(spark, sf):
    return profiling.class_distribution(table(spark, sf, "lineitem"), "l_returnflag")


@register("feature_basic_stats")
def feature_basic_stats(spark, sf):
    return rounded(profiling.basic_stats(dirty_items(spark, sf), DIRTY), 7)


@register("dataset_fingerprint")
def dataset_fingerprint(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    return fingerprint(table(spark, sf, "lineitem"), columns)


@register("dataset_fingerprint_ordered")
def dataset_fingerprint_ordered(spark, sf):
    numbered = readers.with_row_number(table(spark, sf, "lineitem"), "row_number")
    return fingerprint(numbered, ["l_orderkey", "l_returnflag"], "row_number")


@register("dataset_fingerprint_all")
def dataset_fingerprint_all(spark, sf):
    return fingerprint(table(spark, sf, "lineitem"))


@register("dataset_fingerprint_ordered_all")
def dataset_fingerprint_ordered_all(spark, sf):
    return fingerprint(readers.with_row_number(table(spark, sf, "lineitem"), "row_number"), index="row_number")


# ---------------------------------------------------------------- preparation


@register("prepare_features")
def prepare_features(spark, sf):
    source = items(spark, sf).withColumn("y", F.col("y").cast("double"))
    return preparation.prepare_features(source, "y", "k")


@register("variance_filter")
def variance_filter(spark, sf):
    fitted = preparation.fit(dirty_items(spark, sf), DIRTY)
    return fitted.select("feature", "kept")


@register("scale_standard")
def scale_standard(spark, sf):
    source = items(spark, sf)
    return rounded(preparation.apply(source, preparation.fit(source, FEATURES), ["k"]))


@register("scale_robust")
def scale_robust(spark, sf):
    source = items(spark, sf)
    return rounded(preparation.apply(source, preparation.fit(source, FEATURES, "robust"), ["k"]))


@register("fit_apply")
def fit_apply(spark, sf):
    source = vectors(spark, sf)
    fitted = preparation.fit(source, VECTOR_FEATURES)
    return rounded(preparation.apply(source, fitted, ["vec_id", "y"]))


@register("transform_holdout")
def transform_holdout(spark, sf):
    splits = splitting.stratified_split(items(spark, sf), "k", "y", 0.2, SEED)
    fitted = preparation.fit(splits.where(F.col("split") == "train"), FEATURES)
    return rounded(preparation.apply(splits.where(F.col("split") == "test"), fitted, ["k", "y"]))


@register("transform_stream")
def transform_stream(spark, sf):
    batch = table(spark, sf, "events")
    fitted = preparation.fit(batch, ["value"])
    stream = streaming.read_stream(spark, f"{sf}/events.parquet*", batch.schema)
    scaled = streaming.transform_stream(stream, fitted, ["event_id"], 4.0)
    path = shared_folder(spark, "stream")
    streaming.write_available(scaled, f"{path}/rows", f"{path}/checkpoint")
    return rounded(spark.read.schema(scaled.schema).parquet(f"{path}/rows"))


@register("outlier_flag")
def outlier_flag(spark, sf):
    source = events(spark, sf)
    fitted = preparation.fit(source, ["value", "shifted"])
    return preparation.apply(source, fitted, ["event_id"], 4.0).select("event_id", "is_outlier")


@register("stratified_split")
def stratified_split(spark, sf):
    splits = splitting.stratified_split(items(spark, sf), "k", "y", 0.2, SEED)
    return splits.select("k", "y", "split")


@register("split_shapes")
def split_shapes(spark, sf):
    splits = splitting.stratified_split(items(spark, sf), "k", "y", 0.3, 7)
    return profiling.split_shapes(splits, len(FEATURES))


@register("process_full")
def process_full(spark, sf):
    splits, _ = process(dirty_items(spark, sf), JobParams(target="y"), "k")
    return rounded(splits)


@register("process_fit_on_train")
def process_fit_on_train(spark, sf):
    params = JobParams(target="y", scale_method="robust", add_outlier_flag=False)
    splits, _ = process(dirty_items(spark, sf), params, "k", fit_on="train")
    return rounded(splits)


@register("test_split_vector")
def test_split_vector(spark, sf):
    splits, _ = process(items(spark, sf), JobParams(target="y"), "k", clean_first=False)
    rows = select_split(splits, "test", as_vector=True)
    return rows.select("k", "y", joined_vector("features").alias("features"))


@register("preprocess_vector")
def preprocess_vector(spark, sf):
    source = items(spark, sf)
    scaled = preparation.apply(source, preparation.fit(source, FEATURES), ["k"])
    vector = preparation.as_vector(scaled, FEATURES, ["k"])
    return vector.select("k", joined_vector("features").alias("features"))


# ---------------------------------------------------------------- two-class statistics


@register("bootstrap_error")
def bootstrap_error(spark, sf):
    source = table(spark, sf, "lineitem")
    count = resampling.bootstrap_error(source, "l_returnflag", "count")
    share = resampling.bootstrap_error(source, "l_returnflag", "percent")
    return rounded(
        count.withColumn("stat", F.lit("count")).unionByName(
            share.withColumn("stat", F.lit("percent"))
        )
    )


@register("bootstrap_error_sim")
def bootstrap_error_sim(spark, sf):
    return resampling.bootstrap_error_simulated(
        table(spark, sf, "lineitem"), "l_returnflag", N_BOOT, "count", SEED
    )


@register("bootstrap_ci_mean")
def bootstrap_ci_mean(spark, sf):
    return rounded(resampling.bootstrap_ci_mean(items(spark, sf), FEATURES, "k", N_BOOT))


@register("bootstrap_ci_median")
def bootstrap_ci_median(spark, sf):
    return rounded(resampling.bootstrap_ci_median(items(spark, sf), FEATURES))


@register("bootstrap_ci_median_sim")
def bootstrap_ci_median_sim(spark, sf):
    return resampling.bootstrap_ci_median(items(spark, sf), FEATURES, N_BOOT)


@register("cohen_d")
def cohen_d(spark, sf):
    return rounded(twoclass.effect_size(items(spark, sf), FEATURES, "y"), 9)


@register("cliffs_delta")
def cliffs_delta(spark, sf):
    return rounded(twoclass.effect_size(items(spark, sf), FEATURES, "y", "cliffs_delta"), 9)


def _ranks(spark, sf) -> DataFrame:
    return rank_statistics(ranked_values(items(spark, sf), FEATURES, "y"))


@register("mannwhitney")
def mannwhitney(spark, sf):
    tested = twoclass.with_mannwhitney(_ranks(spark, sf))
    return rounded(tested.select("feature", "u_background", "z", "p_mannwhitney"), 8)


@register("ks_two_sample")
def ks_two_sample(spark, sf):
    return rounded(twoclass.with_ks(_ranks(spark, sf)).select("feature", "ks_d", "p_ks"), 8)


@register("ttest_welch")
def ttest_welch(spark, sf):
    tested = twoclass.with_ttest(twoclass.class_moments(items(spark, sf), FEATURES, "y"))
    return rounded(tested.select("feature", "t", "df", "p_ttest"), 8, df=4)


@register("ttest_pooled")
def ttest_pooled(spark, sf):
    moments = twoclass.class_moments(items(spark, sf), FEATURES, "y")
    tested = twoclass.with_ttest(moments, equal_var=True)
    return rounded(tested.select("feature", "t", "df", "p_ttest"), 8)


@register("ttest_documents")
def ttest_documents(spark, sf):
    moments = twoclass.class_moments(labelled_documents(spark, sf), ["n_chars"], "y")
    return rounded(twoclass.with_ttest(moments).select("feature", "t", "df", "p_ttest"), 8, df=4)


def _separation(method: str) -> Query:
    def run(spark, sf):
        found = twoclass.feature_separation(dirty_items(spark, sf), DIRTY, "y", method)
        return rounded(found, 8)

    return run


QUERIES["feature_separation_mw"] = _separation("mannwhitney")
QUERIES["feature_separation_ks"] = _separation("ks")
QUERIES["feature_separation_t"] = _separation("ttest")


@register("feature_auc")
def feature_auc(spark, sf):
    return rounded(twoclass.feature_auc(dirty_items(spark, sf), DIRTY, "y"), 9)


@register("feature_auc_strict")
def feature_auc_strict(spark, sf):
    return rounded(twoclass.feature_auc(dirty_items(spark, sf), DIRTY, "y", strict_nulls=True), 9)


@register("js_divergence")
def js_divergence(spark, sf):
    return rounded(histogram.js_divergence(items(spark, sf), FEATURES, "y"), 9)


@register("js_divergence_shared")
def js_divergence_shared(spark, sf):
    return rounded(histogram.js_divergence(items(spark, sf), FEATURES, "y", binning="shared"), 9)


@register("redundant_pairs")
def redundant_pairs(spark, sf):
    source = items(spark, sf).withColumn("marked_up", F.col("price") * 1.01)
    return rounded(correlation.redundant_pairs(source, [*FEATURES, "marked_up"], 0.9))


def _adjusted(method: str) -> Query:
    def run(spark, sf):
        tests = twoclass.feature_separation(vectors(spark, sf), VECTOR_FEATURES, "y", "ttest")
        adjusted = multitest.adjust_pvalues(tests, "p_value", method)
        return rounded(adjusted.select("feature", "p_value", "p_adjusted"), 7)

    return run


for _name, _method in ADJUSTMENTS.items():
    QUERIES[_name] = _adjusted(_method)


# ---------------------------------------------------------------- tables behind the figures


@register("separation_summary")
def separation(spark, sf):
    return rounded(separation_summary(items(spark, sf), FEATURES, "y"), 8)


@register("separation_summary_ttest")
def separation_ttest(spark, sf):
    found = separation_summary(dirty_items(spark, sf), DIRTY, "y", "ttest", binning="shared")
    return rounded(found, 8)


@register("separation_vectors")
def separation_vectors(spark, sf):
    return rounded(separation_summary(vectors(spark, sf), VECTOR_FEATURES, "y"), 8)


@register("class_kde_vectors")
def class_kde_vectors(spark, sf):
    return _kde_rows(density.kernel_density(vectors(spark, sf), VECTOR_FEATURES, "y"))


@register("trim_percentiles")
def trim_percentiles(spark, sf):
    return rounded(histogram.trim_percentiles(items(spark, sf), FEATURES, "y"))


@register("class_histogram")
def class_histogram(spark, sf):
    return rounded(histogram.class_histogram(items(spark, sf), FEATURES, "y"), 6, density=10)


@register("distribution_histogram")
def distribution_histogram(spark, sf):
    return rounded(histogram.distribution_histogram(events(spark, sf), "value"), 6, density=10)


def _kde_rows(curve: DataFrame) -> DataFrame:
    """Density as probability mass per grid step, which has the same size for every feature."""
    mass = curve.withColumn("mass", F.col("density") * F.col("step")).drop("density", "step")
    return rounded(mass, 6, mass=10)


@register("class_kde")
def class_kde(spark, sf):
    return _kde_rows(density.kernel_density(items(spark, sf), FEATURES, "y"))


@register("class_kde_binned")
def class_kde_binned(spark, sf):
    """The binned form, with an error far below the digits that are kept."""
    curve = density.kernel_density(items(spark, sf), FEATURES, "y", method="binned", tolerance=1e-12)
    return rounded(curve.select("feature", "label", "point", (F.col("density") * F.col("step")).alias("mass")), 6, mass=7)


@register("distribution_kde")
def distribution_kde(spark, sf):
    return _kde_rows(density.kernel_density(events(spark, sf), ["value"]))


@register("class_location")
def class_location(spark, sf):
    return rounded(histogram.class_location(items(spark, sf), FEATURES, "y"), 7)


@register("significance_stars")
def significance_stars(spark, sf):
    tests = twoclass.feature_separation(vectors(spark, sf), VECTOR_FEATURES, "y", "mannwhitney")
    stars = histogram.significance_stars(F.col("p_value")).alias("stars")
    return rounded(tests.select("feature", "p_value", stars), 8)


@register("feature_separation_ks_exact")
def feature_separation_ks_exact(spark, sf):
    """Document lengths by quality label: a few hundred rows."""
    tests = twoclass.feature_separation(labelled_documents(spark, sf), ["n_chars"], "y", "ks", exact=True)
    return rounded(tests, 9)


@register("feature_separation_mannwhitney_exact")
def feature_separation_mannwhitney_exact(spark, sf):
    """Balances of the suppliers of one nation, a handful, against those of all others."""
    rows = table(spark, sf, "supplier").select("s_acctbal", (F.col("s_nationkey") == 3).cast("int").alias("y"))
    return rounded(twoclass.feature_separation(rows, ["s_acctbal"], "y", exact=True), 9)


@register("corr_pearson")
def corr_pearson(spark, sf):
    return rounded(correlation.pearson_pairs(items(spark, sf), [*FEATURES, "y"]), 9)


@register("corr_pearson_nulls")
def corr_pearson_nulls(spark, sf):
    source = cleaning.sentinel_to_null(dirty_items(spark, sf))
    return rounded(correlation.pearson_pairs(source, DIRTY), 9)


@register("corr_spearman")
def corr_spearman(spark, sf):
    return rounded(correlation.spearman_pairs(items(spark, sf), [*FEATURES, "y"], "k"), 9)


@register("corr_spearman_nulls")
def corr_spearman_nulls(spark, sf):
    source = cleaning.sentinel_to_null(dirty_items(spark, sf))
    columns = ["quantity", "price", "discount"]
    return rounded(correlation.spearman_pairs(source, columns, "k"), 9)


@register("corr_spearman_target")
def corr_spearman_target(spark, sf):
    return rounded(correlation.spearman_with_label(items(spark, sf), FEATURES, "y"), 9)


@register("corr_kendall")
def corr_kendall(spark, sf):
    columns = ["quantity", "discount", "tax"]
    return rounded(correlation.kendall_pairs(items(spark, sf), columns, "k"), 9)


@register("corr_kendall_all")
def corr_kendall_all(spark, sf):
    columns = FEATURES
    return rounded(correlation.kendall_pairs(items(spark, sf), columns, "k"), 9)


@register("corr_kendall_target")
def corr_kendall_target(spark, sf):
    return rounded(correlation.kendall_with_label(items(spark, sf), FEATURES, "y"), 9)


@register("corr_per_class")
def corr_per_class(spark, sf):
    found = correlation.pearson_pairs(items(spark, sf), [*FEATURES, "y"], "y")
    named = F.when(F.col("y") == 1, "Signal").otherwise("Background")
    return rounded(found.select(named.alias("label"), "col_a", "col_b", "n", "r"), 9)


def _top(**options) -> Query:
    def run(spark, sf):
        found = correlation.top_correlations(vectors(spark, sf), VECTOR_FEATURES, "y", 10, **options)
        return rounded(found, 9)

    return run


QUERIES["top_correlations"] = _top()
QUERIES["top_correlations_positive"] = _top(positive_only=True)
QUERIES["top_correlations_negative"] = _top(negative_only=True)
QUERIES["top_correlations_spearman"] = _top(method="spearman")
QUERIES["top_correlations_kendall"] = _top(method="kendall")


@register("top_correlations_spearman_numeric_target")
def top_correlations_spearman_numeric_target(spark, sf):
    found = correlation.top_correlations(items(spark, sf), ["quantity", "price", "discount"], "tax", 10, "spearman")
    return rounded(found, 9)


@register("top_correlations_kendall_numeric_target")
def top_correlations_kendall_numeric_target(spark, sf):
    found = correlation.top_correlations(items(spark, sf), ["quantity", "discount"], "tax", 10, "kendall")
    return rounded(found, 9)


TIED = ["quantity", "discount", "tax"]


@register("corr_spearman_per_class")
def corr_spearman_per_class(spark, sf):
    return rounded(correlation.correlation_pairs(items(spark, sf), FEATURES, "spearman", "k", "y"), 9)


@register("corr_kendall_per_class")
def corr_kendall_per_class(spark, sf):
    return rounded(correlation.correlation_pairs(items(spark, sf), TIED, "kendall", "k", "y"), 9)


@register("corr_kendall_nulls")
def corr_kendall_nulls(spark, sf):
    source = cleaning.sentinel_to_null(dirty_items(spark, sf))
    return rounded(correlation.kendall_pairs(source, TIED, "k"), 9)


@register("corr_spearman_vectors_nulls")
def corr_spearman_vectors_nulls(spark, sf):
    """64 features with six patterns of missing values, one of which is none."""
    rows = vectors(spark, sf)
    holed = [
        (F.when(F.col("vec_id") % (7 + i % 6) != 0, F.col(f)) if i % 6 < 5 else F.col(f)).alias(f)
        for i, f in enumerate(VECTOR_FEATURES)
    ]
    return rounded(correlation.spearman_pairs(rows.select("vec_id", *holed), VECTOR_FEATURES, "vec_id"), 9)


@register("top_correlations_per_class")
def top_correlations_per_class(spark, sf):
    return correlation.top_correlations(vectors(spark, sf), VECTOR_FEATURES, "y", 5, per_class=True)


def _by_class(method: str) -> tuple[Query, Query]:
    """Top correlations with the tax and their matrix, inside each class."""
    features = ["quantity", "discount"] if method == "kendall" else ["quantity", "price", "discount"]

    def tops(spark, sf):
        return rounded(correlation.top_correlations(items(spark, sf), features, "tax", 2, method, per_class="y"), 9)

    def matrix(spark, sf):
        rows = items(spark, sf)
        return rounded(correlation.correlation_submatrix(rows, features, "tax", 2, method, "k", per_class="y"), 9)

    return tops, matrix


for _method in correlation.METHODS:
    QUERIES[f"top_correlations_by_class_{_method}"], QUERIES[f"correlation_submatrix_by_class_{_method}"] = _by_class(_method)


def _submatrix_per_class(method: str) -> Query:
    def run(spark, sf):
        columns = TIED[:2] if method == "kendall" else FEATURES
        found = correlation.correlation_submatrix(items(spark, sf), columns, "y", 3, method, "k", per_class=True)
        return rounded(found, 9)

    return run


for _method in correlation.METHODS:
    QUERIES[f"correlation_submatrix_per_class_{_method}"] = _submatrix_per_class(_method)


@register("feature_auc_three_class")
def feature_auc_three_class(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0)
    rows = table(spark, sf, "lineitem").select(status.alias("y"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return twoclass.feature_auc(rows, ["tax", "discount"], "y").select("feature", "auc")


@register("effect_size_dirty")
def effect_size_dirty(spark, sf):
    return rounded(twoclass.effect_size(dirty_items(spark, sf), DIRTY, "y"), 9)


@register("correlation_submatrix")
def correlation_submatrix(spark, sf):
    return rounded(correlation.correlation_submatrix(vectors(spark, sf), VECTOR_FEATURES, "y", 10), 9)


@register("target_distribution")
def target_distribution(spark, sf):
    return rounded(resampling.target_distribution(items(spark, sf), "y", "count"))


@register("target_distribution_percent")
def target_distribution_percent(spark, sf):
    return rounded(resampling.target_distribution(items(spark, sf), "y", "percent"), 9)


@register("summary_csv_roundtrip")
def summary_csv_roundtrip(spark, sf):
    summary = separation_summary(events(spark, sf), ["value", "shifted"], "y", "ks")
    path = sinks.write_summary_csv(summary, shared_folder(spark, "summary"))
    return rounded(spark.read.schema(summary.schema).csv(path, header=True), 8)


@register("pca_scores")
def pca_scores(spark, sf):
    return projection.pca_scores(vectors(spark, sf), VECTOR_FEATURES, ["vec_id", "y"])


@register("pca_explained_variance")
def pca_explained_variance(spark, sf):
    return projection.pca_explained_variance(vectors(spark, sf), VECTOR_FEATURES)


@register("pca_explained_variance_items")
def pca_explained_variance_items(spark, sf):
    features = ["quantity", "price", "discount"]
    return rounded(projection.pca_explained_variance(items(spark, sf), features, 3))


@register("knn_graph")
def knn_graph(spark, sf):
    return rounded(neighbours.knn_graph(vectors(spark, sf), "vec_id", VECTOR_FEATURES, 15))
