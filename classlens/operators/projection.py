"""Principal components of the standardised features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.preparation import fit


def standardise(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Zero mean and unit population variance; a constant feature becomes 0."""
    rows = {r["feature"]: r for r in fit(df, features).collect()}
    return df.select(
        *keep,
        *[((clean_double(f) - rows[f]["center"]) / rows[f]["scale"]).alias(f) for f in features],
    )


def fit_pca(scaled: DataFrame, features: Sequence[str], n_components: int = 2) -> PCAModel:
    """Fit on standardised columns; the driver holds the feature covariance only."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled)
    return PCA(k=n_components, inputCol="_x", outputCol="_pc").fit(vectors)


def pca_scores(
    df: DataFrame, features: Sequence[str], keep: Sequence[str], n_components: int = 2
) -> DataFrame:
    """``(*keep, pc1, pc2, ...)``; each component's largest loading is made positive."""
    scaled = standardise(df, features, keep)
    model = fit_pca(scaled, features, n_components)
    loadings = model.pc.toArray()
    largest = abs(loadings).argmax(axis=0)
    signs = [1.0 if loadings[i, j] > 0 else -1.0 for j, i in enumerate(largest)]
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled)
    scores = model.transform(vectors).withColumn("_pc", vector_to_array("_pc"))
    return scores.select(
        *keep, *[(F.col("_pc")[j] * s).alias(f"pc{j + 1}") for j, s in enumerate(signs)]
    )


def pca_explained_variance(
    df: DataFrame, features: Sequence[str], n_components: int = 2
) -> DataFrame:
    """``(component, ratio, cumulative)``: share of the total variance per component."""
    model = fit_pca(standardise(df, features), features, n_components)
    ratios = [float(v) for v in model.explainedVariance]
    rows = [(i + 1, r, sum(ratios[: i + 1])) for i, r in enumerate(ratios)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")
