"""Tails and quantiles of the classical distributions, in numpy only.

They run on the driver, on a handful of result rows; raw data never passes through here.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _solve(f, lo: float, hi: float, target: float = 0.0, steps: int = 200) -> float:
    """Root of an increasing function by bisection with secant polishing."""
    a, b = f(lo) - target, f(hi) - target
    for _ in range(steps):
        mid = 0.5 * (lo + hi)
        if hi - lo <= 1e-15 * max(1.0, abs(mid)):
            break
        m = f(mid) - target
        if m <= 0:
            lo, a = mid, m
        else:
            hi, b = mid, m
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    if p > 0.5:
        return -norm_ppf(1 - p)
    x = _solve(norm_cdf, -39.0, 0.0, p)
    for _ in range(2):
        d = norm_pdf(x)
        if d > 0:
            x -= (norm_cdf(x) - p) / d
    return x


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    return 1 - gamma_q(a, x) if x >= a + 1 else _gamma_series(a, x)


def _gamma_series(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    for _ in range(100_000):
        n += 1
        term *= x / n
        total += term
        if abs(term) < abs(total) * 1e-17:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    if x < a + 1:
        return 1 - _gamma_series(a, x)
    b, c = x + 1 - a, 1 / TINY
    d = h = 1 / b
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or TINY)
            c = 1 + num / c or TINY
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def chi2_sf(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gamma_q(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    hi = max(10.0, df)
    while gamma_p(df / 2, hi / 2) < p:
        hi *= 2
    return _solve(lambda v: gamma_p(df / 2, v / 2), 0.0, hi, p)


def t_sf(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(df):
        return norm_sf(t)
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t > 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    hi = 10.0
    while t_sf(hi, df) > 1 - p:
        hi *= 4
    return _solve(lambda v: -t_sf(v, df), 0.0, hi, p - 1)


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f):
        return math.nan
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def f_ppf(p: float, d1: float, d2: float) -> float:
    hi = 10.0
    while f_sf(hi, d1, d2) > 1 - p:
        hi *= 4
    return _solve(lambda v: -f_sf(v, d1, d2), 0.0, hi, p - 1)


def beta_ppf(p: float, a: float, b: float) -> float:
    return _solve(lambda v: beta_i(a, b, v), 0.0, 1.0, p)


def tail(stat: float, alternative: str, sf) -> float:
    """P-value from an upper tail function of a symmetric statistic."""
    if math.isnan(stat):
        return math.nan
    if alternative == "greater":
        return sf(stat)
    if alternative == "less":
        return sf(-stat)
    return min(1.0, 2 * sf(abs(stat)))


@lru_cache(64)
def signrank_counts(n: int) -> np.ndarray:
    """Ways to reach each signed-rank sum."""
    c = np.zeros(n * (n + 1) // 2 + 1)
    c[0] = 1
    for k in range(1, n + 1):
        c[k:] = c[k:] + c[:-k].copy()
    return c


def signrank_cdf(q: float, n: int) -> float:
    k = math.floor(q + 1e-7)
    return 0.0 if k < 0 else float(signrank_counts(n)[: k + 1].sum() / 2.0**n)


@lru_cache(64)
def ranksum_counts(m: int, n: int) -> np.ndarray:
    """Ways to reach each Mann-Whitney sum: coefficients of the Gaussian binomial."""
    c = np.zeros(m * n + 1)
    c[0] = 1
    for i in range(1, m + 1):
        up = n + i
        if up <= m * n:
            c[up:] = c[up:] - c[: m * n + 1 - up].copy()
        for s in range(i, m * n + 1):
            c[s] += c[s - i]
    return c


def ranksum_cdf(q: float, m: int, n: int) -> float:
    k = math.floor(q + 1e-7)
    if k < 0:
        return 0.0
    c = ranksum_counts(m, n)
    return float(c[: k + 1].sum() / c.sum())


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of the scaled two-sided statistic."""
    if x <= 0:
        return 1.0
    if x < 1:
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return 1 - math.sqrt(2 * math.pi) / x * s
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))


def hypergeom_logpmf(k: np.ndarray, white: int, black: int, drawn: int) -> np.ndarray:
    lc = np.vectorize(lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1))
    return lc(white, k) + lc(black, drawn - k) - lc(white + black, drawn)


def _legendre(n: int, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(n)
    return 0.5 * (b - a) * x + 0.5 * (b + a), 0.5 * (b - a) * w


_ncdf = np.vectorize(norm_cdf)


def _range_cdf(q: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= q)."""
    z, w = _legendre(160, -8.5, 8.5)
    dens = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    low = _ncdf(z[None, :] - np.asarray(q, float)[:, None])
    inner = np.maximum(_ncdf(z)[None, :] - low, 0.0) ** (k - 1)
    return np.minimum(1.0, k * (inner * (dens * w)[None, :]).sum(1))


def tukey_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range by quadrature over the scale."""
    if math.isnan(q):
        return math.nan
    if q <= 0:
        return 1.0
    if df > 25_000:
        return float(max(0.0, 1 - _range_cdf(np.array([q]), k)[0]))
    sd = math.sqrt(0.5 / df)
    s, w = _legendre(96, max(1e-6, 1 - 9 * sd), 1 + 9 * sd + 3 / df)
    logd = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - (_range_cdf(q * s, k) * np.exp(logd) * w).sum())))


@lru_cache(256)
def tukey_ppf(p: float, k: int, df: float) -> float:
    return _solve(lambda v: -tukey_sf(v, k, df), 0.0, 200.0, p - 1, 60)


def dunnett_cdf(q: float, share: tuple[float, ...], df: float) -> float:
    """P(max |T_i| <= q) of t statistics with correlations l_i l_j, `share` holding l_i squared: quadrature over the common part and the scale."""
    if q <= 0:
        return 0.0
    z, wz = _legendre(96, -8.5, 8.5)
    sd = math.sqrt(0.5 / df)
    s, ws = _legendre(64, max(1e-6, 1 - 9 * sd), 1 + 9 * sd + 3 / df) if df <= 25_000 else (np.ones(1), np.ones(1))
    logd = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2 if df <= 25_000 else np.zeros(1)
    inside = np.ones((len(s), len(z)))
    for v in share:
        l, rest = math.sqrt(v), math.sqrt(1 - v)
        inside *= _ncdf((l * z[None, :] + q * s[:, None]) / rest) - _ncdf((l * z[None, :] - q * s[:, None]) / rest)
    return float(np.clip((np.exp(logd) * ws) @ inside @ (np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * wz), 0.0, 1.0))


@lru_cache(256)
def dunnett_ppf(p: float, share: tuple[float, ...], df: float) -> float:
    lo, hi = 0.0, 2.0
    while dunnett_cdf(hi, share, df) < p:
        lo, hi = hi, 2 * hi
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if dunnett_cdf(mid, share, df) < p else (lo, mid)
    return (lo + hi) / 2


def digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))
