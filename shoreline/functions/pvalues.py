"""p-values of the two-sample Kolmogorov-Smirnov statistic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shoreline.plans.materialize import stored
from shoreline.plans.sizing import broadcast_if_small

_SERIES = (
    "aggregate(sequence(1, 100), 0D, "
    "(a, k) -> a + if(k % 2 = 1, 2D, -2D) * exp(-2D * k * k * {lam} * {lam}))"
)


def _limit_series(lam: str) -> Column:
    series = F.expr(_SERIES.format(lam=f"({lam})"))
    value = F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))
    # Below 0.1 the survival function is 1 to double precision and the series is slow.
    lam_value = F.expr(lam)
    return F.when(lam_value < 0.1, 1.0).when(lam_value.isNotNull(), value)


def ks_pvalue_asymptotic(n1: str, n2: str, d: str) -> Column:
    """Limit distribution of the statistic, as a plain SQL expression."""
    return _limit_series(f"sqrt(({n1} * {n2}) / cast({n1} + {n2} as double)) * {d}")


def ks_pvalue_large(n1: str, n2: str, d: str) -> Column:
    """Limit distribution with the second-order sample-size correction (Vrbik, 2018)."""
    n = f"round({n1} * cast({n2} as double) / ({n1} + {n2}))"
    z = f"(sqrt({n}) * {d})"
    return _limit_series(f"{z} + 1D / (6D * sqrt({n})) + ({z} - 1D) / (4D * {n})")


# Factorials below this are summed up, others come from Stirling's series, whose error is then below 1e-19.
_SUMMED = 256
_SMALL = np.concatenate([[0], np.cumsum(np.log(np.arange(1, _SUMMED, dtype=np.longdouble)))])
_PLACES = 1 << 14  # places of the smaller samples that are worked on at once


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """log k! in extended precision: the logarithms of large factorials cancel each other."""
    x = np.maximum(k, _SUMMED).astype(np.longdouble)
    inverse = 1 / x
    square = inverse * inverse
    series = inverse * (np.longdouble(1) / 12 - square * (np.longdouble(1) / 360 - square * (np.longdouble(1) / 1260 - square / 1680)))
    large = (x + np.longdouble(0.5)) * np.log(x) - x + np.log(2 * np.longdouble(np.pi)) / 2 + series
    # pi itself is known to 53 bits only; what is missing:
    large = large + np.longdouble(1.2246467991473532e-16) / (2 * np.longdouble(np.pi))
    return np.where(k < _SUMMED, _SMALL[np.minimum(k, _SUMMED - 1)], large)


def _walk(m: int, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chance that ``x`` of ``x + y`` independent steps go right, each with probability m / (m + n); 0 for ``y`` below 0."""
    up, both = np.maximum(y, 0), (m + n).astype(np.longdouble)
    logs = _log_factorial(x + up) - _log_factorial(x) - _log_factorial(up) + x * np.log(m / both) + up * np.log(n / both)
    return np.where(y < 0, 0, np.exp(logs)).astype(np.float64)


def _moves(m: int, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_walk` to (x, y) and to (x, y + 1)."""
    near, above = _walk(m, n, x, y), np.maximum(y + 1, 1)
    return near, np.where(y == -1, (m / (m + n)) ** x, near * (n / (m + n)) * ((x + above) / above))


def exceedance(m: int, n: int, steps: np.ndarray) -> np.ndarray:
    """P(D >= h / lcm) for each lattice step ``h``, for sample sizes ``m`` and ``n``.

    A random ordering of the pooled samples is a lattice path to (m, n). A path that leaves the
    band visits one of 2 min(m, n) points at least; the probability that a point is the first one
    follows from those of the points before it. The work depends on the smaller sample alone, and the sum of first
    visits keeps its relative precision however small it is.
    """
    steps = np.asarray(steps, dtype=np.int64)
    return _exceedances(min(m, n), np.full(len(steps), max(m, n), dtype=np.int64), steps)


def _exceedances(m: int, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same for steps with larger samples of their own, many at once."""
    found, left = np.ones(len(h)), np.flatnonzero(h > 0)
    most = max(1, _PLACES // (m + 1))
    for low in range(0, len(left), most):
        part = left[low : low + most]
        found[part] = _first_visits(m, n[part], h[part])
    return found


def _first_visits(m: int, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Chance of each column (n, h) to leave its band, by first visits of the points below and above it.

    With the i-th value of the smaller sample beyond its highest place in the larger one for the first time, a path
    visits (i - 1, that place + 1); before its lowest place for the last time in a row it visits (i, that place - 1).
    The path is taken as a walk of independent steps that ends at (m, n). A move then depends on the distance of its
    ends alone, and points of given sides that are x places apart have one of two distances: logarithms are taken
    for each place, not for each pair of points.
    """
    x = np.arange(m + 1, dtype=np.int64)[:, None]
    shared = np.gcd(m, n)
    up, right = n // shared, m // shared
    # Points outside the lattice can't be reached, or don't lead to (m, n).
    below, above = (x * up - h) // right, (x * up + h - 1) // right + 1
    sizes, size = np.unique(n, return_inverse=True)
    along = x * sizes // m
    level = [t[:, size] for t in (along, *_moves(m, sizes, x, along))]
    sides = lambda low: (low, *_moves(m, n, x, low))
    rise, fall = sides((x * up + 2 * h - 1) // right + 1), sides((x * up - 2 * h + 1) // right - 1)
    first_below, first_above = _walk(m, n, x, below), _walk(m, n, x, above)

    def arriving(first: np.ndarray, places: np.ndarray, k: int, place: np.ndarray, moves: Sequence[np.ndarray], near: int) -> np.ndarray:
        """From points at the first places to one at ``k``; ``near`` is the smallest distance."""
        last = k + 1 - near
        low, short, long = (t[near : k + 1][::-1] for t in moves)
        return np.einsum("kb,kb->b", first[:last], np.where(place - places[:last] > low, long, short))

    for k in range(m + 1):
        before = arriving(first_below, below, k, below[k], level, 1) + arriving(first_above, above, k, below[k], fall, 1)
        first_below[k] = np.maximum(first_below[k] - before, 0)
        before = arriving(first_below, below, k, above[k], rise, 0) + arriving(first_above, above, k, above[k], level, 1)
        first_above[k] = np.maximum(first_above[k] - before, 0)
    ends = first_below * _walk(m, n, m - x, n - below) + first_above * _walk(m, n, m - x, n - above)
    return np.minimum(ends.sum(axis=0) / _walk(m, n, np.int64(m), n), 1)


@F.pandas_udf(DoubleType())
def ks_pvalue_exact(n1: pd.Series, n2: pd.Series, d: pd.Series) -> pd.Series:
    """Exact two-sided p-value; meant for distinct triples, those of one smaller sample size together."""
    a, b = n1.to_numpy(dtype=np.int64), n2.to_numpy(dtype=np.int64)
    small, large = np.minimum(a, b), np.maximum(a, b)
    steps = np.rint(d.to_numpy(dtype=np.float64) * np.lcm(small, large)).astype(np.int64)
    found = np.empty(len(d))
    for m in np.unique(small):
        of = small == m
        found[of] = _exceedances(int(m), large[of], steps[of])
    return pd.Series(found, dtype="float64")


def with_ks_pvalue(
    results: DataFrame, n1: str, n2: str, d: str, method: str, name: str = "p_value"
) -> DataFrame:
    """Adds the p-value: ``exact``, ``limit`` (the corrected limit) or ``asymptotic`` (the plain limit).

    The same formula holds at every size. The exact one costs the square of the smaller sample, in multiplications, for
    each distinct triple (n1, n2, d), whatever the larger one; the triples, which repeat across windows,
    are dealt evenly over all tasks, solved once, many together, and joined back.
    """
    if method == "asymptotic":
        return results.withColumn(name, ks_pvalue_asymptotic(n1, n2, d))
    if method == "limit":
        return results.withColumn(name, ks_pvalue_large(n1, n2, d))
    if method != "exact":
        raise ValueError(f"unknown p-value method: {method}")
    kept = stored(results, "statistics")
    triples = kept.select(F.col(n1).alias("_n1"), F.col(n2).alias("_n2"), F.col(d).alias("_d")).dropna().distinct()
    tasks = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = triples.repartition(tasks, F.xxhash64("_n1", "_n2", "_d"))
    solved = broadcast_if_small(stored(dealt.withColumn(name, ks_pvalue_exact("_n1", "_n2", "_d")), "pvalues"))
    same = (F.col(n1) == F.col("_n1")) & (F.col(n2) == F.col("_n2")) & (F.col(d) == F.col("_d"))
    return kept.join(solved, same, "left").select(*results.columns, name)
