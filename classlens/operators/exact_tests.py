"""Exact two-sided p-values of the Mann-Whitney and Kolmogorov-Smirnov tests for small classes.

They replace the large-sample p-values where a class is small, on the finished statistics: one row per feature, spread
over the tasks. Nothing here sees the data itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Sizes up to which the exact forms are the usual choice: the smaller class for Mann-Whitney, the larger one for KS.
MANNWHITNEY_BELOW, KS_BELOW = 8, 10_000


@lru_cache(maxsize=64)
def _partition_sums(m: int) -> tuple[int, list[int]]:
    """Period, and for x = 0, 1, ... the number of ways to have c_1 + 2 c_2 + ... + m c_m <= x with whole c_i >= 0."""
    period = math.lcm(*range(1, m + 1))
    size = period * (m + 1)
    ways = [1] * size  # parts of size one, summed up to x, leave one more factor 1 / (1 - q)
    for i in range(1, m + 1):
        for x in range(i, size):
            ways[x] += ways[x - i]
    return period, ways


def _bounded_sums(x: int, m: int) -> int:
    """The same number for any x: on each residue it is a polynomial of degree m, fixed by m + 1 known values."""
    if x < 0:
        return 0
    period, ways = _partition_sums(m)
    if x < len(ways):
        return ways[x]
    t, r = divmod(x, period)
    total = Fraction(0)
    for k in range(m + 1):
        term = Fraction(ways[k * period + r])
        for j in range(m + 1):
            if j != k:
                term *= Fraction(t - j, k - j)
        total += term
    return int(total)


def mannwhitney_exact(u: float, n0: int, n1: int) -> float:
    """Two-sided p of U without ties: twice the share of rankings with a U as far out, at most 1.

    The rankings with U <= x are counted from the generating function of U, the product of (1 - q^(n+i)) / (1 - q^i) over
    the m members of the smaller class: its numerator has 2^m terms, and each asks for one number of bounded sums. So
    the larger class may have any size.
    """
    m, n = sorted((n0, n1))
    if m == 0:
        return math.nan
    x = n0 * n1 - math.ceil(max(u, n0 * n1 - u))
    total = 0
    for size in range(m + 1):
        for chosen in combinations(range(1, m + 1), size):
            total += (-1) ** size * _bounded_sums(x - size * n - sum(chosen), m)
    return min(1.0, float(Fraction(2 * total, math.comb(m + n, m))))


def ks_exact(d: float, n0: int, n1: int) -> float:
    """Share of the rankings of both classes whose distance of distributions is at least ``d``.

    A ranking is a lattice path. The share of paths to (i, j) that have been outside the band comes from both
    neighbours before, so each diagonal is one vector operation, and as all terms are positive small shares stay precise.
    """
    m, n = sorted((n0, n1))
    if m == 0:
        return math.nan
    g = math.gcd(m, n)
    far = round(d * (m // g) * n)
    if far <= 0:
        return 1.0
    i = np.arange(m + 1, dtype=np.int64)
    share = np.zeros(m + 1)
    for k in range(1, m + n + 1):
        low, high = max(0, k - n), min(m, k)
        here = i[low : high + 1]
        before = np.concatenate([[0.0], share[:-1]])[low : high + 1]
        new = before * here / k + share[low : high + 1] * (k - here) / k
        new[np.abs(here * (n // g) - (k - here) * (m // g)) >= far] = 1.0
        share = np.zeros(m + 1)
        share[low : high + 1] = new
    return float(min(1.0, share[m]))


def _replaced(stats: DataFrame, column: str, wanted: Callable[[dict], float | None]) -> DataFrame:
    """The column's value where ``wanted`` gives one, on rows dealt one feature to a task."""
    schema: StructType = stats.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            values = []
            for row in rows:
                exact = wanted(row)
                values.append(row[column] if exact is None else exact)
            place = batch.schema.get_field_index(column)
            yield batch.set_column(place, batch.schema.field(place), pa.array(values, batch.schema.field(place).type))

    return stats.repartition("feature").mapInArrow(run, schema)


def exact_mannwhitney(stats: DataFrame) -> DataFrame:
    """Exact ``p_mannwhitney`` where a class has at most 8 values and no value occurs twice."""

    def wanted(row: dict) -> float | None:
        n0, n1 = row["n_background"], row["n_signal"]
        if not n0 or not n1 or min(n0, n1) > MANNWHITNEY_BELOW or row["tied_pairs"] > 0:
            return None
        return mannwhitney_exact(row["u_signal"], n0, n1)

    return _replaced(stats, "p_mannwhitney", wanted)


def exact_ks(stats: DataFrame) -> DataFrame:
    """Exact ``p_ks`` where both classes have at most 10,000 values; ties are allowed."""

    def wanted(row: dict) -> float | None:
        n0, n1 = row["n_background"], row["n_signal"]
        if not n0 or not n1 or max(n0, n1) > KS_BELOW:
            return None
        return ks_exact(row["ks_d"], n0, n1)

    return _replaced(stats, "p_ks", wanted)
