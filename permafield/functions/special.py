"""Special functions in NumPy: regularised incomplete gamma and beta, distribution functions, their inverses and z-equivalents."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_inv = np.frompyfunc(NormalDist().inv_cdf, 1, 1)


def gammaln(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def gammainc_upper(a, x) -> np.ndarray:
    """Q(a, x), the regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    out[np.isnan(a) | np.isnan(x)] = np.nan
    out[x == np.inf] = 0.0
    ok = np.isfinite(a) & np.isfinite(x) & (x > 0) & (a > 0)
    scale = np.zeros(a.shape)
    scale[ok] = np.exp(a[ok] * np.log(x[ok]) - x[ok] - gammaln(a[ok]))
    low = ok & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1 / aa
        total, k = term.copy(), aa.copy()
        for _ in range(10_000):
            k += 1
            term = term * xx / k
            total += term
            if (term < total * 1e-17).all():
                break
        out[low] = 1 - total * scale[low]
    high = ok & ~low
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c = np.full(aa.shape, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - aa)
            b += 2
            d = an * d + b
            d[np.abs(d) < 1e-300] = 1e-300
            c = b + an / c
            c[np.abs(c) < 1e-300] = 1e-300
            d = 1 / d
            step = d * c
            h *= step
            if (np.abs(step - 1) < 1e-16).all():
                break
        out[high] = h * scale[high]
    return np.clip(out, 0, 1)


def betainc(a, b, x) -> np.ndarray:
    """I_x(a, b), the regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    swap = ok & (x > (a + 1) / (a + b + 2))
    aa, bb, xx = np.where(swap, b, a)[ok], np.where(swap, a, b)[ok], np.where(swap, 1 - x, x)[ok]
    if not ok.any():
        return out
    front = np.exp(gammaln(aa + bb) - gammaln(aa) - gammaln(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    c = np.ones(aa.shape)
    d = 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 5000):
        even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        for k in (even, odd):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-16).all():
            break
    value = front * h
    out[ok] = np.where(swap[ok], 1 - value, value)
    return out


def betapdf(x, a, b) -> np.ndarray:
    x = np.asarray(x, float)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    return np.where(inside, np.exp((a - 1) * np.log(y) + (b - 1) * np.log1p(-y) + gammaln(np.asarray(a) + b) - gammaln(a) - gammaln(b)), 0.0)


def betainv(p, a, b) -> np.ndarray:
    """Inverse of :func:`betainc` in x, by bisection."""
    p, a, b = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float), np.asarray(b, float))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(80):
        mid = (low + high) / 2
        less = betainc(a, b, mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, (low + high) / 2))


def normal_sf(z) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(np.asarray(z, float) / math.sqrt(2)), float)


def normal_ppf(p) -> np.ndarray:
    """Inverse normal distribution function, with -inf and inf at 0 and 1."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    value = np.asarray(_inv(np.where(inside, p, 0.5)), float)
    return np.where(inside, value, np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.nan)))


def t_sf(t, df) -> np.ndarray:
    """Upper tail of Student's t."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, tail, 1 - tail)


def f_sf(f, df1, df2) -> np.ndarray:
    """Upper tail of F."""
    f = np.maximum(np.asarray(f, float), 0)
    return betainc(np.asarray(df2) / 2, np.asarray(df1) / 2, df2 / (df2 + df1 * f))


def chi2_sf(x, df) -> np.ndarray:
    return gammainc_upper(np.asarray(df, float) / 2, np.maximum(np.asarray(x, float), 0) / 2)


def statistic_sf(stat, kind: str, df1: float = 1.0, df2: float = 1.0) -> np.ndarray:
    """Parametric upper-tail p of a statistic of ``kind`` t (df2), F (df1, df2), z, X (df1), or R/R2 (correlation with df2)."""
    if kind == "t":
        return t_sf(stat, df2)
    if kind == "F":
        return f_sf(stat, df1, df2)
    if kind == "z":
        return normal_sf(stat)
    if kind == "X":
        return chi2_sf(stat, df1)
    if kind in ("R", "R2"):
        stat = np.asarray(stat, float)
        r2 = stat if kind == "R2" else stat * stat
        if kind == "R":
            return t_sf(stat * np.sqrt(df2 / np.maximum(1 - r2, 1e-300)), df2)
        return f_sf(r2 / df1 / np.maximum((1 - r2) / df2, 1e-300), df1, df2)
    raise ValueError(f"unknown statistic {kind!r}")


def to_z(stat, kind: str, df1: float = 1.0, df2: float = 1.0) -> np.ndarray:
    """The normal deviate with the same upper tail, computed from the nearer tail."""
    p = statistic_sf(stat, kind, df1, df2)
    if kind in ("t", "R"):
        other = statistic_sf(-np.asarray(stat, float), kind, df1, df2)
        return np.where(p < 0.5, -normal_ppf(p), normal_ppf(other))
    return -normal_ppf(p)


def equivalent_z(p) -> np.ndarray:
    """Z of an upper-tail p; infinite below ten machine epsilons, element by element."""
    p = np.asarray(p, float)
    return np.where(p < 10 * np.finfo(float).eps, np.inf, normal_ppf(1 - np.clip(p, 0, 1)))
