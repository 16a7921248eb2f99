"""Multiple-testing correction of a table of p-values (one row per test).

The table has one row per feature, so ordering it inside one window per family is bounded by the width
of the feature table; Hommel's procedure takes a family as one group for the same reason. NULL p-values stay NULL and are not counted as tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

METHODS = (
    "bonferroni",
    "sidak",
    "holm",
    "holm-sidak",
    "simes-hochberg",
    "hommel",
    "fdr_bh",
    "fdr_by",
    "fdr_tsbh",
    "fdr_tsbky",
    "fdr_gbs",
)
#: Other names of the methods, as statistics packages use them. Fixed values.
ALIASES = {
    "b": "bonferroni",
    "bonf": "bonferroni",
    "s": "sidak",
    "h": "holm",
    "hs": "holm-sidak",
    "sh": "simes-hochberg",
    "ho": "hommel",
    "fdr_i": "fdr_bh",
    "fdr_p": "fdr_bh",
    "fdri": "fdr_bh",
    "fdrp": "fdr_bh",
    "fdr_n": "fdr_by",
    "fdr_c": "fdr_by",
    "fdrn": "fdr_by",
    "fdrcorr": "fdr_by",
    "fdr_2sbh": "fdr_tsbh",
    "fdr_2sbky": "fdr_tsbky",
    "fdr_twostage": "fdr_tsbky",
}


def _sidak(p: Column, tests: Column) -> Column:
    return F.when(p >= 1.0, 1.0).otherwise(-F.expm1(tests * F.log1p(-F.least(p, F.lit(1.0 - 1e-16)))))


def _tangents(p: np.ndarray) -> np.ndarray:
    """For j = 1 .. m the least j p_(m-j+k) / k over k = 1 .. j, of ascending p-values, in O(m log m).

    ``p_(r) / (r - t)`` with t = m - j is the slope from the point (t, 0) to (r, p_(r)). The least slope touches the lower
    convex hull of the points to the right of t. Taking t down from m - 1 adds one point at a time on the left, so the
    hull is a stack, and the touching point is found by bisection: slopes seen from (t, 0) fall up to it and then rise.
    """
    m = len(p)
    y = p.tolist()
    hull: list[int] = []  # 1-based ranks from right to left
    out = np.empty(m)
    for t in range(m - 1, -1, -1):
        r = t + 1
        while len(hull) > 1:
            a, b = hull[-1], hull[-2]
            if (y[a - 1] - y[r - 1]) * (b - r) >= (y[b - 1] - y[r - 1]) * (a - r):
                hull.pop()
            else:
                break
        hull.append(r)
        low, high = 0, len(hull) - 1  # places in the stack: the wanted one is the leftmost minimum of a valley
        while low < high:
            mid = (low + high) // 2
            a, b = hull[mid], hull[mid + 1]
            if y[a - 1] * (b - t) <= y[b - 1] * (a - t):
                high = mid
            else:
                low = mid + 1
        out[m - t - 1] = (m - t) * y[hull[low] - 1] / (hull[low] - t)
    return out


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's closed testing procedure for p-values in any order, in O(m log m).

    With s_j from ``_tangents``, the i-th smallest p becomes the largest of p, of s_j over j > m - i, and of
    min(j p, s_j) over j <= m - i. In the last term s_j may be replaced by its maximum from j to m - i; j p then rises and
    the other falls, so bisection finds where they cross, with a table of maxima over stretches of doubling length.
    """
    m = len(p)
    if m < 2:
        return np.minimum(p, 1.0)
    order = np.argsort(p, kind="stable")
    y = p[order]
    s = _tangents(y)
    tables = [s]
    while 2 << (len(tables) - 1) <= m:
        half, last = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.maximum(last[:-half], last[half:]))
    width = max(map(len, tables))
    table = np.stack([np.pad(x, (0, width - len(x))) for x in tables])

    def highest(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Largest s_j for j from ``first`` to ``last``, 0-based and inclusive."""
        k = np.floor(np.log2(last - first + 1)).astype(int)
        return np.maximum(table[k, first], table[k, last - (1 << k) + 1])

    i = np.arange(1, m + 1)
    above = np.maximum.accumulate(s[::-1])[::-1]
    out = np.maximum(y, above[m - i])
    some = i < m
    low, high, own = np.zeros(some.sum(), int), (m - i[some]) - 1, y[some]
    last = high.copy()
    while (low < high).any():  # the first j at which j p is no less than the maximum from there on
        mid = (low + high) // 2
        crossed = (mid + 1) * own >= highest(mid, last)
        low, high = np.where(crossed, low, np.minimum(mid + 1, high)), np.where(crossed, mid, high)
    best = np.minimum((low + 1) * own, highest(low, last))
    before = np.maximum(low - 1, 0)
    best = np.maximum(best, np.minimum((before + 1) * own, highest(before, last)))
    out[some] = np.maximum(out[some], best)
    result = np.empty(m)
    result[order] = np.minimum(out, 1.0)
    return result


def _hommel_rows(p: str):
    def run(rows: pa.Table) -> pa.Table:
        values = rows.column(p).cast(pa.float64()).to_numpy(zero_copy_only=False)
        tested = ~np.isnan(values)
        values = values.copy()
        values[tested] = hommel(values[tested])
        return rows.append_column("p_adjusted", pa.array(values, pa.float64(), mask=~tested))

    return run


def adjust_pvalues(
    df: DataFrame,
    p: str = "p_value",
    method: str = "fdr_bh",
    family: str | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Add ``p_adjusted``; an unknown method returns the raw p-values and says so in ``corrected`` (false).

    ``family`` names a column whose values are corrected separately. ``alpha`` matters to the two-stage
    methods only, which estimate the number of true nulls at that level.
    """
    method = ALIASES.get(method, method)
    if method not in METHODS:
        return df.withColumn("p_adjusted", F.col(p)).withColumn("corrected", F.lit(False))
    if method == "hommel":
        schema = StructType([*df.schema.fields, StructField("p_adjusted", DoubleType())])
        families = df.groupBy(*([family] if family else []))
        return families.applyInArrow(_hommel_rows(p), schema)
    group = F.struct(
        F.col(p).isNotNull().alias("tested"),
        (F.col(family) if family else F.lit(1)).alias("family"),
    )
    up = Window.partitionBy(group).orderBy(F.col(p))
    down = Window.partitionBy(group).orderBy(F.col(p).desc())
    whole = Window.partitionBy(group)
    raw = F.col(p)
    i, m = F.row_number().over(up).cast("double"), F.count(F.lit(1)).over(whole).cast("double")
    work = df.withColumn("_i", i).withColumn("_m", m)
    i, m = F.col("_i"), F.col("_m")
    left = m - i + 1.0

    def step_up(column: Column) -> Column:
        return F.min(column).over(down.rangeBetween(Window.unboundedPreceding, 0))

    def step_down(column: Column) -> Column:
        return F.max(column).over(up.rangeBetween(Window.unboundedPreceding, 0))

    if method == "bonferroni":
        adjusted = raw * m
    elif method == "sidak":
        adjusted = _sidak(raw, m)
    elif method == "holm":
        adjusted = step_down(raw * left)
    elif method == "holm-sidak":
        adjusted = step_down(_sidak(raw, left))
    elif method == "simes-hochberg":
        adjusted = step_up(raw * left)
    elif method == "fdr_gbs":
        work = work.withColumn("_q", step_down(F.try_divide(left / i * raw, 1.0 - raw)))
        adjusted = step_up(F.col("_q"))
    else:
        work = work.withColumn("_bh", step_up(raw * m / i))
        adjusted = F.col("_bh")
        if method == "fdr_by":
            harmonic = F.aggregate(
                F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda acc, k: acc + 1.0 / k
            )
            adjusted = step_up(raw * m / i * harmonic)
        elif method in ("fdr_tsbh", "fdr_tsbky"):
            factor = 1.0 + alpha if method == "fdr_tsbky" else 1.0
            rejected = F.count_if(F.col("_bh") <= alpha / factor).over(whole).cast("double")
            nulls = F.when((rejected == 0) | (rejected == m), m).otherwise(m - rejected)
            adjusted = F.least(F.col("_bh"), F.lit(1.0)) * nulls / m * factor
    final = F.when(raw.isNotNull(), F.least(adjusted, F.lit(1.0)))
    return work.withColumn("p_adjusted", final).select(*df.columns, "p_adjusted")
