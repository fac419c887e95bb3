"""Exact null distributions of the rank and ECDF statistics of two small samples.

Both are counts of arrangements of the n + m labels, all of them equally likely if the
samples come from one distribution without ties. They run on result rows, one per group.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions import distributions as D

SMALL_SAMPLE = 8  # rank test: exact if one sample is at most this large and nothing is tied
MOST_CELLS = 1_000_000  # beyond n * m of this size the ranks of the smaller sample are like uniform draws
LARGEST_KS = 10_000


def _counts(n: int, m: int, most: int) -> np.ndarray:
    """Number of arrangements of n and m labels with U = 0 … most, as whole numbers: labels
    are added one at a time, (1 - q^(m+i)) / (1 - q^i) each."""
    counts = np.zeros(most + 1, object)
    counts[0] = 1
    for i in range(1, n + 1):
        if m + i <= most:
            counts[m + i :] -= counts[: most + 1 - m - i].copy()
        rows = -(-(most + 1) // i)
        padded = np.zeros(rows * i, object)
        padded[: most + 1] = counts
        counts = np.cumsum(padded.reshape(rows, i), axis=0).reshape(-1)[: most + 1]
    return counts


def _uniform_sum_cdf(x: float, n: int) -> float:
    """P(sum of n uniform draws <= x)."""
    return sum((-1) ** k * math.comb(n, k) * max(x - k, 0.0) ** n for k in range(n + 1)) / math.factorial(n)


@lru_cache(maxsize=4096)
def _rank_tail(n: int, m: int, low: int) -> float:
    """P(U <= low)."""
    n, m = min(n, m), max(n, m)
    if n * m > MOST_CELLS:
        return _uniform_sum_cdf((low + (n + 1) / 2) / (m + 1), n)
    return float(sum(_counts(n, m, low).tolist()) / math.comb(n + m, n)) if low >= 0 else 0.0


def rank_p(n, m, u):
    """Two-sided p of U, without ties: twice the tail beyond the more extreme side."""
    out = []
    for a, b, x in zip(n, m, u):
        if not (a >= 1 and b >= 1):
            out.append(math.nan)
            continue
        a, b = int(a), int(b)
        out.append(min(1.0, 2 * _rank_tail(a, b, int(round(min(x, a * b - x))))))
    return np.array(out, float)


@lru_cache(maxsize=4096)
def _paths_inside(n: int, m: int, h: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) with |i m - j n| < h all the way.
    A row of the lattice is the running sum of the row below, inside the band."""
    row, log_scale, low, high = np.ones(1), 0.0, 0, -1
    for i in range(n + 1):
        new_low, new_high = max(0, (i * m - h) // n + 1), min(m, -((-i * m - h) // n) - 1)
        if new_low > new_high:
            return 0.0
        fresh = np.zeros(new_high - new_low + 1)
        if i == 0:
            fresh[:] = 1.0
        else:
            a, b = max(low, new_low), min(high, new_high)
            if a > b:
                return 0.0
            fresh[a - new_low : b - new_low + 1] = row[a - low : b - low + 1]
            fresh = np.cumsum(fresh)
        top = fresh.max()
        row, log_scale, low, high = fresh / top, log_scale + math.log(top), new_low, new_high
    if high < m:
        return 0.0
    log_all = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return float(row[m - low] * math.exp(log_scale - log_all))


def ks_p(n, m, d):
    """P(D >= d) of the two-sample statistic: exact up to ``LARGEST_KS``, else large-sample."""
    out = []
    for a, b, x in zip(n, m, d):
        if not (a >= 1 and b >= 1) or math.isnan(x):
            out.append(math.nan)
        elif max(a, b) > LARGEST_KS:
            out.append(float(D.kolmogorov_sf(np.array([x * math.sqrt(a * b / (a + b))]))[0]))
        else:
            out.append(min(1.0, max(0.0, 1 - _paths_inside(int(a), int(b), int(round(x * a * b))))))
    return np.array(out, float)


def _column3(fn):
    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(dtype=float), b.to_numpy(dtype=float), c.to_numpy(dtype=float)))

    return three


def p_rank(n: Column, m: Column, u: Column) -> Column:
    return _column3(rank_p)(n.cast("double"), m.cast("double"), u.cast("double"))


def p_ks(n: Column, m: Column, d: Column) -> Column:
    return _column3(ks_p)(n.cast("double"), m.cast("double"), d.cast("double"))
