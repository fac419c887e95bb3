"""Tail probabilities and quantiles as Arrow-batched column functions.

Spark SQL has no incomplete beta, incomplete gamma or error function. These run on
result rows (one per group), vectorised over the batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
# Beyond this size of a parameter the expansions below would need very many steps; the
# normal forms that replace them err by less than 1e-6 there.
LARGE = 1e4
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a, b, x):
    """Regularised incomplete beta by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                step = d * c
                h = h * step
            if np.nanmax(np.abs(step - 1), initial=0.0) < 1e-14:
                break
        value = np.where(z <= 0, 0.0, np.where((np.abs(step - 1) < 1e-9) | (z >= 1), front * h, np.nan))
    return np.where(flip, 1 - value, value)


def gamma_upper(a, x):
    """Regularised upper incomplete gamma: series below a + 1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 1000):
            term = term * x / (a + n)
            total = total + term
            if np.max(np.nan_to_num(np.abs(term) / np.abs(total)), initial=0.0) < 1e-15:
                break
        low = np.where(np.abs(term) < 1e-9 * np.abs(total), 1 - front * total, np.nan)
        b = x + 1 - a
        c = np.full_like(x, 1 / _TINY)
        d = 1 / np.where(np.abs(b) < _TINY, _TINY, b)
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if np.nanmax(np.abs(step - 1), initial=0.0) < 1e-15:
                break
        high = np.where(np.abs(step - 1) < 1e-9, front * h, np.nan)
    out = np.where(x < a + 1, low, high)
    return np.where(x <= 0, 1.0, np.where(np.isinf(x), 0.0, out))


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
        small = np.minimum(df, LARGE)
        exact = beta_inc(small / 2, 0.5, np.where(np.isnan(x), 1.0, x))
        # normal tail of the transformed statistic (Wallace): sqrt(df log(1 + t^2 / df)) (8 df + 1) / (8 df + 3)
        z = np.sqrt(df * np.log1p(t * t / df)) * (8 * df + 1) / (8 * df + 3)
        far = _erfc(np.nan_to_num(z, nan=0.0, posinf=1e300) / math.sqrt(2))
    return np.where(np.isnan(t) | np.isnan(df), np.nan, np.where(df > LARGE, far, exact))


def chi2_sf(x, df):
    x, df = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(df, dtype=float))
    with np.errstate(all="ignore"):
        exact = gamma_upper(np.minimum(df, LARGE) / 2, np.where(np.isnan(x), 0.0, x) / 2)
        # normal tail of the cube root (Wilson and Hilferty)
        z = (np.cbrt(np.maximum(x, 0) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
        far = 0.5 * _erfc(np.nan_to_num(z, nan=0.0, posinf=1e300) / math.sqrt(2))
    return np.where(np.isnan(x), np.nan, np.where(df > LARGE, far, exact))


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2))


def _bisect(sf, target, lo, hi):
    """Solve sf(x) = target for a decreasing sf; the upper end grows until it is beyond."""
    lo, hi = np.full_like(target, lo), np.full_like(target, hi)
    for _ in range(1000):
        short = (sf(hi) > target) & np.isfinite(hi)
        if not short.any():
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = sf(mid) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def t_quantile(p, df):
    """Upper quantile: t with P(T <= t) = p, for p >= 0.5."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    return _bisect(lambda x: t_two_sided(x, df) / 2, 1 - p, 0.0, 64.0)


def chi2_quantile(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    return _bisect(lambda x: chi2_sf(x, df), 1 - p, 0.0, 64.0)


def norm_quantile(p):
    return _bisect(norm_sf, 1 - np.asarray(p, dtype=float), -40.0, 40.0)


def kolmogorov_sf(x):
    x = np.asarray(x, dtype=float)
    k = np.arange(1, 101)[:, None]
    with np.errstate(all="ignore"):
        value = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * np.atleast_1d(x) ** 2), axis=0)
    return np.where(np.atleast_1d(x) < 0.2, 1.0, np.clip(value, 0.0, 1.0)).reshape(x.shape)


def _column(fn):
    @F.pandas_udf("double")
    def one(a: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(dtype=float)))

    return one


def _column2(fn):
    @F.pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(dtype=float), b.to_numpy(dtype=float)))

    return two


def p_t(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""
    return _column2(t_two_sided)(t.cast("double"), df.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    return _column2(chi2_sf)(x.cast("double"), df.cast("double"))


def p_norm_two_sided(z: Column) -> Column:
    return _column(lambda v: 2 * norm_sf(np.abs(v)))(z.cast("double"))


def p_norm_upper(z: Column) -> Column:
    return _column(norm_sf)(z.cast("double"))


def p_kolmogorov(x: Column) -> Column:
    return _column(kolmogorov_sf)(x.cast("double"))


def q_t(p: float, df: Column) -> Column:
    return _column(lambda v: t_quantile(p, v))(df.cast("double"))


def q_chi2(p: float, df: Column) -> Column:
    return _column(lambda v: chi2_quantile(p, v))(df.cast("double"))


def critical_chi2(alpha: float = 0.05, df: int = 1) -> float:
    return float(chi2_quantile(np.array([1 - alpha]), np.array([float(df)]))[0])


def critical_norm(alpha: float = 0.05, two_sided: bool = True) -> float:
    return float(norm_quantile(np.array([1 - alpha / (2 if two_sided else 1)]))[0])


def sig_label(p: Column, none: str = "n.s.", missing: str = "n/a") -> Column:
    """``***`` / ``**`` / ``*`` at .001 / .01 / .05; missing p first."""
    return (
        F.when(p.isNull() | F.isnan(p), F.lit(missing))
        .when(p < 0.001, F.lit("***"))
        .when(p < 0.01, F.lit("**"))
        .when(p < 0.05, F.lit("*"))
        .otherwise(F.lit(none))
    )
