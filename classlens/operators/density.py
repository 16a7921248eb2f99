"""Gaussian kernel densities on a regular grid.

The exact form adds up the kernel of every value at every grid point, in tasks that collapse equal values first and keep
one sum per grid point. The binned form deals the values to the cells of a finer grid, each to its two neighbours by
distance, and then adds the kernels of the cells: after one pass over the rows its work depends on the two grids
alone, not on rows or ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classlens.functions.numeric import clean_double
from classlens.operators.longform import long_form, spread

GRID = 200
CUT = 3.0
METHODS = ("exact", "binned")
#: Error that the binned form may make, as a share of the height of one value's kernel.
TOLERANCE = 1e-6
#: Kernel terms that a task holds at a time.
TERMS = 1 << 21


def grid_shape(df: DataFrame, features: Sequence[str], label: str | None = None, grid: int = GRID, cut: float = CUT) -> DataFrame:
    """``(feature[, label], n, bw, start, step)``: Scott's bandwidth and the grid; constant features have none."""
    keys = ["feature", "label"] if label else ["feature"]
    bandwidth = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return (
        long_form(df, features, label)
        .groupBy(*keys)
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("a"),
            F.max("value").alias("b"),
            F.stddev_samp("value").alias("std"),
        )
        .where((F.col("std") > 0) & (F.col("a") < F.col("b")))
        .withColumn("bw", bandwidth)
        .withColumn("start", F.col("a") - cut * F.col("bw"))
        .withColumn("step", (F.col("b") + cut * F.col("bw") - F.col("start")) / float(grid - 1))
        .select(*keys, "n", "bw", "start", "step")
    )


def _kernel_sums(at: np.ndarray, weight: np.ndarray, shape: dict, grid: int) -> np.ndarray:
    """Weighted sum of the kernels of values, at each grid point."""
    total = np.zeros(grid)
    points = shape["start"] + shape["step"] * np.arange(grid)
    chunk = max(1, TERMS // grid)
    for i in range(0, len(at), chunk):
        u = (points[None, :] - at[i : i + chunk, None]) / shape["bw"]
        np.multiply(u, u, out=u)
        np.multiply(u, -0.5, out=u)
        np.exp(u, out=u)
        total += weight[i : i + chunk] @ u
    return total


def _by_class(batch: pa.RecordBatch, shapes: list[dict]) -> Iterator[tuple[int, dict, np.ndarray]]:
    """The values of each wanted feature (and class) in a batch."""
    labels = batch.column("_label").to_numpy(zero_copy_only=False) if "_label" in batch.schema.names else None
    columns: dict[str, np.ndarray] = {}
    for k, shape in enumerate(shapes):
        name = shape["column"]
        if name not in columns:
            columns[name] = batch.column(name).to_numpy(zero_copy_only=False)
        x = columns[name]
        if labels is not None:
            x = x[labels == shape["label"]]
        x = x[~np.isnan(x)]
        if len(x):
            yield k, shape, x


_SUMS = pa.schema([("k", pa.int32()), ("point", pa.int32()), ("total", pa.float64())])
_CELLS = pa.schema([("k", pa.int32()), ("cell", pa.int64()), ("weight", pa.float64())])


def _exact_sums(shapes: list[dict], grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, shape, x in _by_class(batch, shapes):
                values, counts = np.unique(x, return_counts=True)
                found = _kernel_sums(values, counts.astype(float), shape, grid)
                totals[k] = totals[k] + found if k in totals else found
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * grid, pa.int32()), pa.array(range(grid), pa.int32()), pa.array(total)], schema=_SUMS
            )

    return run


def _finer(shape: dict, tolerance: float) -> int:
    """Cells per grid step. Linear binning is off by at most (cell / bw) ** 2 / 8 of the kernel's height per value."""
    return max(1, math.ceil(shape["step"] / shape["bw"] / math.sqrt(8.0 * tolerance)))


def _cell_weights(shapes: list[dict], tolerance: float):
    """Each batch's values dealt to the cells on both sides; cells add up in the aggregation that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shape, x in _by_class(batch, shapes):
                place = (x - shape["start"]) / shape["step"] * _finer(shape, tolerance)
                low = np.floor(place)
                share = place - low
                cells, where = np.unique(np.concatenate([low, low + 1.0]), return_inverse=True)
                weight = np.bincount(where, np.concatenate([1.0 - share, share]))
                columns = [pa.array([k] * len(cells), pa.int32()), pa.array(cells.astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, schema=_CELLS)

    return run


def _folded(shapes: list[dict], grid: int, tolerance: float):
    """The kernels of the cells of one feature (and class), any part of them, at every grid point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            which, cell, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "cell", "weight"))
            for k in np.unique(which).tolist():
                shape, own = shapes[k], which == k
                at = shape["start"] + shape["step"] / _finer(shape, tolerance) * cell[own]
                found = _kernel_sums(at, weight[own], shape, grid)
                totals[k] = totals[k] + found if k in totals else found
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * grid, pa.int32()), pa.array(range(grid), pa.int32()), pa.array(total)], schema=_SUMS
            )

    return run


def kernel_density(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    grid: int = GRID,
    cut: float = CUT,
    method: str = "exact",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(feature[, label], point, x, step, density)`` with Scott's bandwidth, per class when ``label``.

    The grid runs from ``cut`` bandwidths below the smallest to ``cut`` above the largest value. With ``method="exact"``
    every distinct value of a task's batch is evaluated at every grid point. With ``"binned"`` the density differs by at
    most ``tolerance`` times the kernel's height, that is ``tolerance / (bw * sqrt(2 pi))``, and the second step
    works on at most ``grid * step / bw / sqrt(8 tolerance)`` cells per feature and class. The shape of the grids, a row
    per feature and class, passes through the driver; sums and cells collapse before and in the shuffle. Constant
    features have no density.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    keys = ["feature", "label"] if label else ["feature"]
    shape = grid_shape(df, features, label, grid, cut)
    rows = shape.collect()
    number = {f: f"c{i}" for i, f in enumerate(features)}
    shapes = [{**r.asDict(), "column": number[r["feature"]]} for r in rows]
    numbered = df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} {t}" for n, t in shape.dtypes))
    wide = df.select(
        *([F.col(label).cast("int").alias("_label")] if label else []),
        *[clean_double(f).alias(number[f]) for f in features],
    )
    if label:
        wide = wide.where(F.col("_label").isin(0, 1))
    wide = spread(wide)
    if method == "exact":
        partial = wide.mapInArrow(_exact_sums(shapes, grid), "k int, point int, total double")
    else:
        cells = wide.mapInArrow(_cell_weights(shapes, tolerance), "k int, cell long, weight double")
        cells = cells.groupBy("k", "cell").agg(F.sum("weight").alias("weight"))
        partial = cells.mapInArrow(_folded(shapes, grid, tolerance), "k int, point int, total double")
    sums = partial.groupBy("k", "point").agg(F.sum("total").alias("total"))
    whole = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    norm = F.col("n") * F.col("bw") * math.sqrt(2.0 * math.pi)
    return whole.join(F.broadcast(sums), ["k", "point"], "left").select(
        *keys,
        "point",
        (F.col("start") + F.col("step") * F.col("point")).alias("x"),
        "step",
        (F.coalesce("total", F.lit(0.0)) / norm).alias("density"),
    )
