"""Principal components and maximum-likelihood factor analysis from one covariance pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import dist
from lattica.plans.blocks import block_sum
from lattica.plans.finish import frame


def moments(df: DataFrame, cols: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and covariance (n - 1) of complete rows; centred at rough means so that sums keep their digits."""
    rough = [float(v or 0.0) for v in df.agg(*(F.avg(F.col(c).cast("double")) for c in cols)).first()]
    k = len(cols)
    g = block_sum(df, [F.lit(1.0), *(F.col(c) - F.lit(m) for c, m in zip(cols, rough))], lambda m: m.T @ m).reshape(k + 1, k + 1)
    n, d = g[0, 0], g[0, 1:] / g[0, 0]
    return n, np.array(rough) + d, (g[1:, 1:] - n * np.outer(d, d)) / (n - 1)


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive, so that results don't depend on the solver."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def pca(df: DataFrame, cols: list[str], scale: bool = False) -> DataFrame:
    """One row a component and variable: loading, and the component's deviation and share of variance."""
    _, _, s = moments(df, cols)
    if scale:
        sd = np.sqrt(np.diag(s))
        s = s / np.outer(sd, sd)
    w, v = np.linalg.eigh(s)
    w, v = np.maximum(w[::-1], 0), signed(v[:, ::-1])
    rows = [(i + 1, c, float(v[j, i]), float(math.sqrt(w[i])), float(w[i] / w.sum())) for i in range(len(cols)) for j, c in enumerate(cols)]
    return frame(df.sparkSession, rows, "component int, variable string, loading double, sdev double, proportion double")


def pca_scores(df: DataFrame, cols: list[str], n_components: int, scale: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Rows projected on the first components, as column expressions: no shuffle."""
    _, mean, s = moments(df, cols)
    sd = np.sqrt(np.diag(s)) if scale else np.ones(len(cols))
    w, v = np.linalg.eigh(s / np.outer(sd, sd))
    v = signed(v[:, ::-1])[:, :n_components]
    score = lambda i: sum(((F.col(c) - float(mean[j])) * float(v[j, i] / sd[j]) for j, c in enumerate(cols)), F.lit(0.0))
    return df.select(*(keep or []), *(score(i).alias(f"pc{i + 1}") for i in range(n_components)))


def varimax(a: np.ndarray, steps: int = 1000, tol: float = 1e-8) -> np.ndarray:
    """Kaiser-normalised varimax rotation of loadings."""
    h = np.sqrt((a**2).sum(1, keepdims=True))
    x, t, last = a / h, np.eye(a.shape[1]), 0.0
    for _ in range(steps):
        z = x @ t
        u, s, vt = np.linalg.svd(x.T @ (z**3 - z * (z**2).mean(0)))
        t = u @ vt
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    return x @ t * h


def promax(a: np.ndarray, power: int = 4) -> np.ndarray:
    """Oblique rotation towards powered varimax loadings."""
    x = varimax(a)
    q = x * np.abs(x) ** (power - 1)
    u = np.linalg.lstsq(x, q, rcond=None)[0]
    d = np.diag(np.linalg.inv(u.T @ u))
    return x @ (u * np.sqrt(d))


def factor_analysis(df: DataFrame, cols: list[str], n_factors: int, rotation: str = "varimax", max_iter: int = 2000, tol: float = 1e-9) -> DataFrame:
    """Maximum-likelihood factors of the correlation matrix by EM on uniquenesses; loadings, uniqueness and the fit test."""
    n, _, s = moments(df, cols)
    sd = np.sqrt(np.diag(s))
    r, p = s / np.outer(sd, sd), len(cols)
    psi = (1 - 0.5 * n_factors / p) / np.diag(np.linalg.inv(r))
    load = np.zeros((p, n_factors))
    for _ in range(max_iter):
        w, v = np.linalg.eigh(r / np.sqrt(np.outer(psi, psi)))
        top = np.argsort(w)[::-1][:n_factors]
        load = np.sqrt(psi)[:, None] * v[:, top] * np.sqrt(np.maximum(w[top] - 1, 0))
        new = np.clip(np.diag(r) - (load**2).sum(1), 0.005, 1.0)
        if np.abs(new - psi).max() < tol:
            break
        psi = new
    sigma = load @ load.T + np.diag(psi)
    fit = np.linalg.slogdet(sigma)[1] - np.linalg.slogdet(r)[1] + np.trace(r @ np.linalg.inv(sigma)) - p
    d = ((p - n_factors) ** 2 - p - n_factors) / 2
    stat = (n - 1 - (2 * p + 5) / 6 - 2 * n_factors / 3) * fit
    pv = dist.chi2_sf(max(stat, 0.0), d) if d > 0 else math.nan
    if n_factors > 1 and rotation != "none":
        load = {"varimax": varimax, "promax": promax}[rotation](load)
    load = signed(load)
    rows = [(c, i + 1, float(load[j, i]), float(psi[j]), float(stat), float(d), float(pv)) for j, c in enumerate(cols) for i in range(n_factors)]
    return frame(df.sparkSession, rows, "variable string, factor int, loading double, uniqueness double, statistic double, df double, p_value double")


def factor_scores(df: DataFrame, cols: list[str], factors: DataFrame, method: str = "regression", keep: list[str] | None = None) -> DataFrame:
    """Scores factor_1, ... of every row from the loadings that `factor_analysis` returned: Thomson's (regression) or Bartlett's.

    Column expressions on standardised variables; a row with a missing value gets null scores.
    """
    got = {(r["variable"], r["factor"]): (r["loading"], r["uniqueness"]) for r in factors.collect()}  # a row a variable and factor
    k = max(f for _, f in got)
    load = np.array([[got[c, f][0] for f in range(1, k + 1)] for c in cols])
    psi = np.array([got[c, 1][1] for c in cols])
    _, mean, s = moments(df, cols)
    sd = np.sqrt(np.diag(s))
    if method == "regression":
        weight = np.linalg.solve(s / np.outer(sd, sd), load)
    elif method == "bartlett":
        scaled = load / psi[:, None]
        weight = scaled @ np.linalg.inv(load.T @ scaled)
    else:
        raise ValueError(f"no scoring method {method!r}")
    score = lambda f: sum(((F.col(c).cast("double") - float(mean[j])) * float(weight[j, f] / sd[j]) for j, c in enumerate(cols)), F.lit(0.0))
    return df.select(*(keep or []), *(score(f).alias(f"factor_{f + 1}") for f in range(k)))
